"""Metrics, folds, blending, conformal bands, bootstrap, learners and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatiofuse import constants as C
from spatiofuse.functions.quantiles import exact_quantiles
from spatiofuse.operators.folds import with_sensor_folds
from spatiofuse.operators import baselines, blend, bootstrap, conformal, folds, grid, learners, metrics, neighbors, reports
from spatiofuse.plans import features, fuse, validate
from spatiofuse.plans.catalog.base import folded, panel, query, reference_daily, sources
from spatiofuse.plans.catalog.scans import aqi_sql
from spatiofuse.plans.catalog.spatial import IDW8, PAIRS, REGRESSION, baseline_pairs, smoky_pool
from spatiofuse.plans.catalog.sqltext import out, sql
from spatiofuse.session import cut_lineage
from spatiofuse.sources import sinks

# Out-of-fold seed table: three interpolation predictors stand in for trained models.
OOF_CTES = {
    "ranked": baseline_pairs(), "idw8": IDW8,
    "oof": """SELECT p.sensor_id, p.date, p.fold, p.lat, p.lon, p.target, p.pm25, p.n_err, n.v AS nearest, w.idw
 FROM folded p LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) n ON p.sensor_id = n.sensor_id AND p.date = n.date
 LEFT JOIN idw8 w ON p.sensor_id = w.sensor_id AND p.date = w.date""",
}


def oof_sql(body: str, *names: str, **ctes: str) -> str:
    return sql(body, "folded", *names, **OOF_CTES, **ctes)


def oof_table(i):
    """Keyed rows with the nearest and IDW out-of-fold predictions."""
    f = cut_lineage(folded(i).select("sensor_id", "date", "fold", "lat", "lon", "target", "pm25", "n_err"))
    keys = ["sensor_id", "date"]
    return cut_lineage(f.join(baselines.spatial_baselines(f), keys))


# Metrics on the direct pair (raw reading as the prediction of the target): cheap inputs, every row.

@query("metrics_by_day", sql(out(f"SELECT date, {REGRESSION} FROM (SELECT date, target AS y, pm25 AS p FROM panel WHERE target IS NOT NULL) GROUP BY 1", "r2 rmse mae bias"), "panel"))
def metrics_by_day(i):
    return metrics.regression_metrics(panel(i), "target", "pm25", ["date"])


@query("pooled_metrics", sql(out(f"SELECT {REGRESSION} FROM (SELECT target AS y, pm25 AS p FROM panel WHERE target IS NOT NULL)", "r2 rmse mae bias", ""), "panel"))
def pooled_metrics(i):
    return metrics.regression_metrics(panel(i), "target", "pm25")


@query("fold_model_metrics", oof_sql(out(f"""SELECT fold, model, {REGRESSION} FROM (SELECT fold, unnest(['nearest', 'idw']) AS model, target AS y, unnest([nearest, idw]) AS p FROM oof)
WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2""", "r2 rmse mae bias", "")))
def fold_model_metrics(i):
    return metrics.model_metrics(oof_table(i), "target", ["nearest", "idw"], ["fold"])


@query("site_metrics", sql(out(f"SELECT sensor_id, {REGRESSION} FROM (SELECT sensor_id, target AS y, pm25 AS p FROM panel WHERE target IS NOT NULL) GROUP BY 1 HAVING COUNT(*) >= 8", "r2 rmse mae bias", ""), "panel"))
def site_metrics(i):
    return metrics.regression_metrics(panel(i), "target", "pm25", ["sensor_id"], min_rows=8)


@query("strata_metrics", sql(out(f"""SELECT stratum, {REGRESSION} FROM (SELECT target AS y, pm25 AS p, unnest([CASE WHEN smoke THEN 'smoke' END, CASE WHEN dusty THEN 'dust' END,
 CASE WHEN NOT smoke AND NOT dusty THEN 'clean' END]) AS stratum FROM (SELECT *, n_err > 0 AS smoke, coalesce(humidity > (SELECT quantile_cont(humidity, 0.75) FROM panel), false) AS dusty FROM panel WHERE target IS NOT NULL))
WHERE stratum IS NOT NULL GROUP BY 1""", "r2 rmse mae bias", ""), "panel"))
def strata(i):
    return metrics.strata_metrics(panel(i), "target", "pm25", "n_err", "humidity")


@query("dust_source_choice", sql("SELECT 'humidity' AS source, COUNT(humidity) AS n FROM panel", "panel"))
def dust_source_choice(i):
    df = panel(i).withColumn("dust", F.lit(None).cast("double"))
    name = metrics.dust_source(df, ("dust", "humidity"))
    return df.agg(F.count(name).alias("n")).select(F.lit(name).alias("source"), "n")


@query("spatial_temporal_r2", sql(out("""SELECT (SELECT 1 - SUM((p-y)*(p-y))/(var_pop(y)*COUNT(*)) FROM s) AS spatial_r2, (SELECT COUNT(*) FROM s) AS n_sensors,
 1 - SUM((ap-ay)*(ap-ay))/(var_pop(ay)*COUNT(*)) AS temporal_r2, COUNT(*) AS n FROM a""", "spatial_r2 temporal_r2", ""), "panel",
    s="SELECT sensor_id, AVG(target) AS y, AVG(pm25) AS p FROM panel WHERE target IS NOT NULL GROUP BY 1",
    a="SELECT target - s.y AS ay, pm25 - s.p AS ap FROM panel JOIN s USING (sensor_id) WHERE target IS NOT NULL"))
def spatial_temporal(i):
    return metrics.spatial_temporal_r2(panel(i), "target", "pm25")


CONF = f"SELECT {aqi_sql('target')} AS ct, {aqi_sql('pm25')} AS cp FROM panel WHERE target IS NOT NULL"


@query("aqi_metrics", sql(out("""SELECT (SELECT AVG((ct = cp)::INT) FROM conf) AS category_accuracy, (SELECT AVG(f1) FROM (SELECT 2.0*COUNT(*) FILTER (ct = k AND cp = k)/(COUNT(*) FILTER (ct = k) + COUNT(*) FILTER (cp = k)) AS f1
 FROM conf, range(0, 6) t(k) GROUP BY k HAVING COUNT(*) FILTER (ct = k) > 0)) AS macro_f1,
 COUNT(*) FILTER (ct >= 2 AND cp >= 2)/nullif(COUNT(*) FILTER (cp >= 2), 0) AS exceedance_precision,
 COUNT(*) FILTER (ct >= 2 AND cp >= 2)/nullif(COUNT(*) FILTER (ct >= 2), 0) AS exceedance_recall, COUNT(*) AS n, COUNT(*) FILTER (ct >= 2) AS n_exceedance_true FROM conf""",
    "category_accuracy macro_f1 exceedance_precision exceedance_recall", ""), "panel", conf=CONF))
def aqi_metrics(i):
    return metrics.aqi_metrics(panel(i), "target", "pm25")


@query("aqi_confusion_matrix", sql(out("SELECT ct, " + ", ".join(f"COUNT(*) FILTER (cp = {k}) AS n{k}" for k in range(6)) + ", COUNT(*) AS total, "
    + ", ".join(f"COUNT(*) FILTER (cp = {k})/COUNT(*) AS share{k}" for k in range(6)) + " FROM conf GROUP BY 1", " ".join(f"share{k}" for k in range(6)), ""), "panel", conf=CONF))
def aqi_confusion_matrix(i):
    return metrics.confusion_matrix(panel(i), "target", "pm25")


@query("exceedance_by_tier", sql(out("""SELECT tier, COUNT(*) FILTER (t AND h)/nullif(COUNT(*) FILTER (h), 0) AS exceedance_precision, COUNT(*) FILTER (t AND h)/nullif(COUNT(*) FILTER (t), 0) AS exceedance_recall,
 COUNT(*) FILTER (t) AS n_exceedance_true FROM (SELECT tier, """ + aqi_sql("y") + " >= 2 AS t, " + aqi_sql("p") + """ >= 2 AS h FROM (SELECT target AS y, unnest(['pm25', 'humidity']) AS tier, unnest([pm25, humidity]) AS p FROM panel)
 WHERE y IS NOT NULL AND p IS NOT NULL) GROUP BY 1""", "exceedance_precision exceedance_recall", ""), "panel"))
def exceedance_by_tier(i):
    return metrics.exceedance_by_tier(panel(i), "target", ["pm25", "humidity"])


@query("interval_coverage", sql(out("""SELECT date, AVG((target BETWEEN pm25 - 20 AND pm25 + 5)::INT) AS coverage, AVG(pm25 + 5 - (pm25 - 20)) AS mean_width, COUNT(*) AS n FROM panel WHERE target IS NOT NULL GROUP BY 1""", "coverage mean_width"), "panel"))
def interval_coverage(i):
    df = panel(i).withColumns({"lo": F.col("pm25") - 20, "hi": F.col("pm25") + 5})
    return metrics.interval_coverage(df, "target", "lo", "hi", ["date"])


@query("prior_baselines", sql(out("""SELECT model, """ + REGRESSION + """ FROM (SELECT target AS y, unnest(['raw_pm25', 'debiased_pm25']) AS model, unnest([pm25, pm25 - (SELECT AVG(pm25 - target) FROM panel WHERE target IS NOT NULL)]) AS p FROM panel WHERE target IS NOT NULL) GROUP BY 1""", "r2 rmse mae bias", ""), "panel"))
def prior_baselines(i):
    return metrics.model_metrics(validate.baseline_columns(panel(i), ("pm25",)), "target", ["raw_pm25", "debiased_pm25"])


@query("prior_offset", sql(out("SELECT AVG(pm25 - target) AS prior_offset, COUNT(*) AS n FROM panel WHERE target IS NOT NULL", "prior_offset", ""), "panel"))
def prior_offset(i):
    return metrics.prior_offset(panel(i), "pm25")


MORAN = f"""SELECT date, COUNT(*) AS n, SUM(z*lag)/SUM(z*z) AS morans_i FROM (
 SELECT r.sensor_id, r.date, r.v - d.m AS z, AVG(l.v) - MIN(d.m) AS lag FROM res r JOIN (SELECT date, AVG(v) AS m, COUNT(*) AS n FROM res GROUP BY 1) d ON r.date = d.date
 JOIN (SELECT *, row_number() OVER (PARTITION BY sensor_id, date ORDER BY d, other) AS rn FROM pairs) l ON l.sensor_id = r.sensor_id AND l.date = r.date AND l.rn <= 8
 WHERE d.n >= 15 GROUP BY r.sensor_id, r.date, r.v, d.m) GROUP BY 1"""
MORAN_CTES = {"res": "SELECT sensor_id, date, lat, lon, pm25 - target AS v FROM panel WHERE target IS NOT NULL",
              "pairs": PAIRS.replace("FROM panel a JOIN panel b", "FROM res a JOIN res b").replace("b.target AS v", "b.v").replace("AND b.target IS NOT NULL", "")}


def residual_panel(i):
    return panel(i).filter("target IS NOT NULL").withColumn("residual", F.col("pm25") - F.col("target"))


@query("morans_by_day", sql(out(MORAN, "morans_i"), "panel", **MORAN_CTES))
def morans_by_day(i):
    return metrics.morans_by_day(residual_panel(i))


@query("morans_summary", sql(out(f"SELECT AVG(morans_i) AS mean, quantile_cont(morans_i, 0.5) AS median, quantile_cont(morans_i, 0.75) - quantile_cont(morans_i, 0.25) AS iqr, COUNT(*) AS n_days FROM ({MORAN})", "mean median iqr", ""), "panel", **MORAN_CTES))
def morans_summary(i):
    return metrics.morans_summary(metrics.morans_by_day(residual_panel(i)))


# Folds ---------------------------------------------------------------------

@query("sensor_folds", sql("SELECT sensor_id, fold::INT AS fold FROM folds", "folds"))
def sensor_folds(i):
    return folds.sensor_folds(panel(i))


@query("spatial_block_folds")
def spatial_block_folds(i):
    return folds.block_folds(panel(i)).select("sensor_id", "block")


@query("temporal_split", sql(out("SELECT sensor_id, date, date >= DATE '2024-01-20' AS is_test FROM panel"), "panel"))
def temporal_split(i):
    return folds.temporal_flag(panel(i), "2024-01-20").select("sensor_id", "date", "is_test")


CAL = """SELECT sensor_id, rn <= greatest(1, round_even(0.25::DOUBLE*n, 0)) AS is_cal FROM (SELECT sensor_id, row_number() OVER (ORDER BY md5('42:' || sensor_id)) AS rn, COUNT(*) OVER () AS n FROM (SELECT DISTINCT sensor_id FROM panel))"""


@query("calibration_split", sql(out("SELECT sensor_id, date, is_cal FROM panel JOIN cal USING (sensor_id)"), "panel", cal=CAL))
def calibration_split(i):
    return folds.calibration_flag(panel(i)).select("sensor_id", "date", "is_cal")


@query("frozen_folds")
def frozen_folds(i):
    return folds.frozen_folds(panel(i), cutoff="2024-01-20")


@query("early_stopping_tail", sql(out("""SELECT sensor_id, date, n >= 200 AND rn <= least(greatest(round_even(0.1::DOUBLE*n, 0), 100), 50000, n // 2) AS is_tail FROM (SELECT sensor_id, date, COUNT(*) OVER () AS n,
 row_number() OVER (ORDER BY date DESC, md5('tail:' || sensor_id || ':' || date)) AS rn FROM panel)"""), "panel"))
def early_stopping_tail(i):
    return folds.early_stopping_tail(panel(i)).select("sensor_id", "date", "is_tail")


@query("aligned_frames", sql("SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right, COUNT(*) AS shared FROM panel", "panel"))
def aligned_frames(i):
    return sinks.key_differences(folded(i), panel(i), ["sensor_id", "date"])


# Blending, stacking, intervals -----------------------------------------------

GRAM2 = """SELECT {by} COUNT(*) AS n, SUM((target - idw)*(nearest - idw)) AS num, SUM((nearest - idw)*(nearest - idw)) AS den FROM oof WHERE target IS NOT NULL AND nearest IS NOT NULL AND idw IS NOT NULL {group}"""


@query("simplex_blend", oof_sql(out("""SELECT sensor_id, date, greatest(w*nearest + (1-w)*idw, 0) + 0*nearest AS blend, w AS weight_nearest
FROM oof, (SELECT least(greatest(num/den, 0), 1) AS w FROM g)""", "blend weight_nearest"), g=GRAM2.format(by="", group="")))
def simplex_blend(i):
    df, w = blend.simplex_blend(oof_table(i), ["nearest", "idw"])
    return df.select("sensor_id", "date", "blend", F.lit(w["nearest"]).alias("weight_nearest"))


@query("held_out_blend", oof_sql(out("""SELECT sensor_id, date, greatest(w*nearest + (1-w)*idw, 0) + 0*nearest AS blend_lofo
FROM oof JOIN (SELECT f.fold, least(greatest(SUM(num)/SUM(den), 0), 1) AS w FROM (SELECT DISTINCT fold FROM oof) f JOIN g ON g.fold <> f.fold GROUP BY 1) USING (fold)""", "blend_lofo"),
    g=GRAM2.format(by="fold,", group="GROUP BY 1")))
def held_out_blend(i):
    df, _ = blend.held_out_blend(oof_table(i), ["nearest", "idw"])
    return df.select("sensor_id", "date", "blend_lofo")


def ridge2(stats: str, key: str) -> str:
    """Two-part non-negative ridge in closed form: the best feasible support."""
    return f"""SELECT {key} w1, w2, my - w1*m1 - w2*m2 AS b, m1, m2 FROM (
 SELECT *, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN greatest(v1, 0)*greatest(v1, 0)*a11 >= greatest(v2, 0)*greatest(v2, 0)*a22 THEN greatest(v1, 0) ELSE 0 END AS w1,
  CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN greatest(v1, 0)*greatest(v1, 0)*a11 >= greatest(v2, 0)*greatest(v2, 0)*a22 THEN 0 ELSE greatest(v2, 0) END AS w2 FROM (
  SELECT *, (b1*a22 - b2*a12)/(a11*a22 - a12*a12) AS u1, (b2*a11 - b1*a12)/(a11*a22 - a12*a12) AS u2, b1/a11 AS v1, b2/a22 AS v2 FROM (
   SELECT *, s11/1 - n*m1*m1 + 1.0 AS a11, s22 - n*m2*m2 + 1.0 AS a22, s12 - n*m1*m2 AS a12, t1 - n*m1*my AS b1, t2 - n*m2*my AS b2 FROM ({stats}))))"""


RIDGE_SUMS = """COUNT(*)::DOUBLE AS n, AVG(nearest) AS m1, AVG(idw) AS m2, AVG(target) AS my, SUM(nearest*nearest) AS s11, SUM(idw*idw) AS s22, SUM(nearest*idw) AS s12, SUM(nearest*target) AS t1, SUM(idw*target) AS t2"""
COMPLETE = "target IS NOT NULL AND nearest IS NOT NULL AND idw IS NOT NULL"


@query("ridge_stack", oof_sql(out("""SELECT sensor_id, date, greatest(b + w1*coalesce(nearest, m1) + w2*coalesce(idw, m2), 0) AS meta FROM oof, ridge""", "meta"),
    ridge=ridge2(f"SELECT {RIDGE_SUMS} FROM oof WHERE {COMPLETE}", "")))
def ridge_stack(i):
    t = oof_table(i).withColumn("dead", F.lit(None).cast("double"))
    stack = blend.fit_stack(t, ["nearest", "idw", "dead"])
    return t.select("sensor_id", "date", blend.stack_prediction(stack).alias("meta"))


META = """SELECT sensor_id, ntile(4) OVER (ORDER BY md5('42:' || sensor_id)) AS mf FROM (SELECT DISTINCT sensor_id FROM oof)"""


@query("cross_fit_stack", oof_sql(out("""SELECT o.sensor_id, o.date, greatest(r.b + w1*coalesce(nearest, m1) + w2*coalesce(idw, m2), 0) AS crossfit FROM oof o JOIN meta USING (sensor_id) JOIN ridge r ON r.f = meta.mf""", "crossfit"),
    meta=META, ridge=ridge2(f"SELECT f, {RIDGE_SUMS} FROM oof JOIN meta USING (sensor_id), range(1, 5) t(f) WHERE mf <> f AND {COMPLETE} GROUP BY f", "f,")))
def cross_fit_stack(i):
    df, _ = blend.cross_fit_stack(oof_table(i), ["nearest", "idw"])
    return df.select("sensor_id", "date", "crossfit")


@query("quantile_rearrangement", sql(out("""SELECT sensor_id, date, CASE WHEN ok THEN q[1] ELSE target END AS q05, CASE WHEN ok THEN q[2] ELSE pm25 END AS q50, CASE WHEN ok THEN q[3] ELSE temperature END AS q95
FROM (SELECT *, target IS NOT NULL AS ok, list_sort([target, pm25, temperature]) AS q FROM panel)""", "q05 q50 q95"), "panel"))
def quantile_rearrangement(i):
    df = panel(i).select("sensor_id", "date", F.col("target").alias("q05"), F.col("pm25").alias("q50"), F.col("temperature").alias("q95"))
    return conformal.rearranged(df, ["q05", "q50", "q95"])


BAND = "SELECT *, pm25*0.4::DOUBLE AS lo, pm25*0.6::DOUBLE + 2 AS hi, greatest(pm25*0.4::DOUBLE - target, target - (pm25*0.6::DOUBLE + 2)) AS score FROM panel JOIN cal USING (sensor_id) WHERE target IS NOT NULL"


def banded(i):
    df = folds.calibration_flag(panel(i))
    return cut_lineage(df.withColumns({"lo": F.col("pm25") * 0.4, "hi": F.col("pm25") * 0.6 + 2}).select("sensor_id", "date", "is_cal", "target", "lo", "hi"))


@query("conformal_delta", sql(out("""SELECT n, score AS delta FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, COUNT(*) OVER () AS n FROM band WHERE is_cal)
WHERE rn = CASE WHEN ceil((n + 1)*0.9::DOUBLE) < n THEN ceil((n + 1)*0.9::DOUBLE) + 1 ELSE n END""", "delta", ""), "panel", cal=CAL, band=BAND))
def conformal_delta(i):
    return conformal.conformal_delta(banded(i).filter("is_cal"))


@query("coverage_curve", sql(out("""SELECT nominal, delta, AVG((e.score <= delta)::INT) AS empirical FROM (SELECT 1.0::DOUBLE - a AS nominal, MIN(score) FILTER (rn = ceil(least(1.0::DOUBLE, (1.0::DOUBLE - a)*(1.0::DOUBLE + 1.0::DOUBLE/n))*(n - 1)) + 1) AS delta
 FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, COUNT(*) OVER () AS n FROM band WHERE is_cal),
 (SELECT unnest([""" + ", ".join(f"{a}::DOUBLE" for a in conformal.default_alphas()) + """]) AS a) GROUP BY a), (SELECT score FROM band WHERE NOT is_cal) e GROUP BY 1, 2""", "nominal delta empirical", ""), "panel", cal=CAL, band=BAND))
def coverage_curve(i):
    t = banded(i)
    return conformal.coverage_curve(t.filter("is_cal"), t.filter("NOT is_cal"), conformal.default_alphas())


@query("recentred_band", sql(out("SELECT sensor_id, date, target - (pm25 - pm25*0.5::DOUBLE) AS lo, target + (pm25*1.5::DOUBLE - pm25) AS hi FROM panel", "lo hi"), "panel"))
def recentred_band(i):
    df = panel(i).withColumns({"q05": F.col("pm25") * 0.5, "q50": F.col("pm25"), "q95": F.col("pm25") * 1.5})
    return conformal.recentred(df, "target").select("sensor_id", "date", "lo", "hi")


def boot_sql(row_sums: str, draw: str, final: str, extra: str = "") -> str:
    return sql(out(final, extra, ""), "panel",
        ok="SELECT sensor_id, date, target AS y, pm25 AS p, pm25*0.5::DOUBLE AS q FROM panel WHERE target IS NOT NULL",
        clusters=f"SELECT row_number() OVER (ORDER BY md5('0:cluster:' || sensor_id)) AS slot, * FROM (SELECT sensor_id, COUNT(*) AS n, {row_sums} FROM ok, (SELECT AVG(y) AS m FROM ok) GROUP BY 1)",
        draws=f"""SELECT b, {draw} FROM (SELECT b, ('0x' || substr(md5('0:' || b || ':' || slot), 1, 8))::BIGINT % (SELECT COUNT(*) FROM clusters) + 1 AS pick FROM clusters, range(0, 1000) t(b)) d
 JOIN clusters c ON c.slot = d.pick GROUP BY b""")


@query("bootstrap_ci", boot_sql("SUM(y - m) AS sy, SUM((y - m)*(y - m)) AS sy2, SUM((p - y)*(p - y)) AS se2",
    "1 - SUM(se2)/(SUM(sy2) - SUM(sy)*SUM(sy)/SUM(n)) AS r2, sqrt(SUM(se2)/SUM(n)) AS rmse",
    "SELECT quantile_cont(r2, 0.025) AS r2_lo, quantile_cont(r2, 0.975) AS r2_hi, quantile_cont(rmse, 0.025) AS rmse_lo, quantile_cont(rmse, 0.975) AS rmse_hi, COUNT(*) AS n_boot FROM draws", "r2_lo r2_hi rmse_lo rmse_hi"))
def bootstrap_interval(i):
    return bootstrap.bootstrap_ci(panel(i), "target", "pm25", "sensor_id")


@query("paired_delta_r2", boot_sql("SUM(y - m) AS sy, SUM((y - m)*(y - m)) AS sy2, SUM((p - y)*(p - y)) AS sr2, SUM((q - y)*(q - y)) AS sa2",
    "(SUM(sr2) - SUM(sa2))/(SUM(sy2) - SUM(sy)*SUM(sy)/SUM(n)) AS d",
    """SELECT (SELECT (SUM(sr2) - SUM(sa2))/(SUM(sy2) - SUM(sy)*SUM(sy)/SUM(n)) FROM clusters) AS delta_r2, (SELECT COUNT(*) FROM clusters) AS n_clusters, (SELECT SUM(n)::BIGINT FROM clusters) AS n_rows,
 quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi FROM draws""", "delta_r2 ci_lo ci_hi"))
def paired_delta(i):
    return bootstrap.paired_delta_r2(panel(i).withColumn("half", F.col("pm25") * 0.5), "target", "pm25", "half")


@query("enriched_metrics")
def enriched_metrics(i):
    return validate.enriched(panel(i), "target", "pm25")


# Learners --------------------------------------------------------------------

def learning_frame(i, n: int = C.SENSOR_FOLDS, per_fold: bool = True):
    """Training frame with sensor folds, its model inputs, and (``per_fold``) the neighbour columns recomputed without each fold."""
    src = sources(i)
    df = features.with_tract_columns(features.training_frame(panel(i), src), src.tracts, C.DEMOGRAPHIC_COLUMNS)  # for the ablation
    df = cut_lineage(with_sensor_folds(df.withColumns({"latitude": F.col("lat"), "longitude": F.col("lon")}), n))
    return df, features.feature_columns(df), cut_lineage(neighbors.neighbor_features_per_fold(df)) if per_fold else None


@query("train_medians", sql(out("SELECT fold, quantile_cont(humidity, 0.5) AS humidity, quantile_cont(temperature, 0.5) AS temperature, quantile_cont(target, 0.5) AS target FROM folded GROUP BY 1", "humidity temperature target", ""), "folded"))
def train_medians(i):
    f = cut_lineage(folded(i).select("fold", "humidity", "temperature", "target"))
    parts = [exact_quantiles(f, c, {c: 0.5}, ["fold"]).drop("n") for c in ("humidity", "temperature", "target")]
    return parts[0].join(parts[1], "fold").join(parts[2], "fold")


@query("cross_validated_learners")
def cross_validated_learners(i):
    frame, names, overrides = learning_frame(i)
    oof, _ = learners.cross_validated(frame, names, None, overrides)
    return oof.select("sensor_id", "date", "fold", "target", "oof", "oof_lofo")


@query("quantile_heads")
def quantile_heads(i):
    frame, names, overrides = learning_frame(i)
    return learners.quantile_out_of_fold(frame, names, overrides=overrides)


@query("permutation_importance")
def permutation_importance(i):
    frame, names, _ = learning_frame(i, per_fold=False)  # one fit on all rows
    bundle = learners.fit_learners(frame, names, learners.resolve_learners())
    return learners.top_importances(learners.permutation_importance(frame, bundle.predict, names))


@query("fused_prediction")
def fused_prediction(i):
    frame, names, overrides = learning_frame(i)
    bands = learners.quantile_out_of_fold(frame, names, overrides=overrides).select("sensor_id", "date", "q05", "q50", "q95")
    t = fuse.with_residual_kriging(oof_table(i), "idw").join(bands, ["sensor_id", "date"])
    result = fuse.fuse(t, ["nearest", "idw", "rk"])
    return result.table.select("sensor_id", "date", "is_cal", "centre", "band_lo", "band_hi")


@query("feature_set_ablation")
def feature_set_ablation(i):
    frame, names, overrides = learning_frame(i)
    return validate.ablation(frame, names, ["no_neighbor", "no_external", "plus_demographics"], overrides, ["huber"], C.DEMOGRAPHIC_COLUMNS)


def deployed(i):
    """Full fit on the training frame, and the reference site-days with the same features."""
    src = sources(i)
    frame = cut_lineage(features.training_frame(panel(i), src))
    frame = frame.withColumns({"latitude": F.col("lat"), "longitude": F.col("lon")})
    bundle = learners.fit_full(frame, features.feature_columns(frame), ["forest", "huber"])
    return src, frame, bundle


@query("external_validation")
def external_validation(i):
    src, frame, bundle = deployed(i)
    rows = cut_lineage(validate.external_rows(reference_daily(i), smoky_pool(i), src))
    report = validate.external_validation(rows, bundle.predict)
    names = ["r2", "rmse", "mae", "bias", "n"]
    pooled = report["pooled"].select(F.lit("all").alias("site_id"), *names)
    yearly = report["by_year"].select(F.col("year").cast("string").alias("site_id"), *names)
    return report["by_site"].select("site_id", *names).unionByName(pooled).unionByName(yearly)


@query("deployment_stack")
def deployment_stack(i):
    src, frame, bundle = deployed(i)
    rows = cut_lineage(validate.external_rows(reference_daily(i), smoky_pool(i), src))
    stack = blend.Stack(["tier1", "rk", "surface"], [0.8, 0.3, 0.1], 1.0, {"surface": 20.0})
    g = grid.grid_over(i.tracts, 0.1)
    surface = grid.pixel_targets(grid.supervision(panel(i), g))
    return validate.deployment_stack(frame, rows, bundle, stack, surface.withColumnRenamed("y", "pm25"), g)


@query("surface_export")
def surface_export(i):
    src, frame, bundle = deployed(i)
    g = grid.grid_over(i.tracts, 1.0)
    surface = cut_lineage(validate.scored_surface(panel(i), g, smoky_pool(i), src, bundle.predict))
    return validate.surface_manifest(surface, g)


# Reports ---------------------------------------------------------------------

@query("sensor_inventory", sql(out("SELECT sensor_id, median(lat) AS lat, median(lon) AS lon, COUNT(*) AS n FROM panel GROUP BY 1", "lat lon", ""), "panel"))
def sensor_inventory(i):
    return reports.sensor_inventory(panel(i))


@query("active_sensors_by_month", out("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(DISTINCT o_custkey) AS active FROM orders GROUP BY 1", "", "month"))
def active_sensors_by_month(i):
    feed = i.table("orders").select(F.col("o_custkey").alias("sensor_id"), F.to_date("o_orderdate").alias("date"))
    return reports.active_by_month(feed)


@query("activity_summary", """SELECT MIN(active) FILTER (m = lo) AS first_n, MIN(active) FILTER (m = hi) AS last_n, MAX(active) AS peak_n FROM (SELECT *, MIN(m) OVER () AS lo, MAX(m) OVER () AS hi
FROM (SELECT date_trunc('month', o_orderdate) AS m, COUNT(DISTINCT o_custkey) AS active FROM orders GROUP BY 1))""")
def activity_summary(i):
    return reports.activity_summary(active_sensors_by_month(i))


@query("coverage_windows", sql(out("""SELECT 'sensors' AS source, MIN(date) AS first_date, MAX(date) AS last_date FROM panel UNION ALL SELECT 'reference', MIN(date), MAX(date) FROM reference_daily
UNION ALL SELECT 'cells', MIN(date), MAX(date) FROM daily_cells""", "", "first_date last_date"), "panel", "reference_daily", "daily_cells"))
def coverage_windows(i):
    return reports.coverage_windows({"sensors": panel(i), "reference": reference_daily(i), "cells": i.daily_cells})


@query("correction_by_humidity", sql(out("""SELECT bin, (bin + 0.5)*2.5 AS centre, COUNT(*) AS n, AVG(delta) AS mean, quantile_cont(delta, 0.25) AS q25, quantile_cont(delta, 0.75) AS q75
FROM (SELECT floor(humidity/2.5)::INT AS bin, target - pm25 AS delta FROM panel WHERE humidity IS NOT NULL) WHERE bin BETWEEN 0 AND 39 GROUP BY 1 HAVING COUNT(*) >= 30""", "centre mean q25 q75", ""), "panel"))
def correction_by_humidity(i):
    return reports.correction_by_humidity(panel(i))


HEX = """SELECT lattice, hx, hy, COUNT(*) AS n FROM (SELECT CASE WHEN w THEN 0 ELSE 1 END AS lattice, (CASE WHEN w THEN u1 ELSE u2 END)::BIGINT AS hx, (CASE WHEN w THEN v1 ELSE v2 END)::BIGINT AS hy FROM (
 SELECT *, (u-u1)*(u-u1) + 3.0::DOUBLE*(v-v1)*(v-v1) < (u-u2-0.5::DOUBLE)*(u-u2-0.5::DOUBLE) + 3.0::DOUBLE*(v-v2-0.5::DOUBLE)*(v-v2-0.5::DOUBLE) AS w FROM (
  SELECT u, v, round_even(u, 0) AS u1, round_even(v, 0) AS v1, floor(u) AS u2, floor(v) AS v2 FROM (
   SELECT (x + pad)/((hi + pad*2)/55.0::DOUBLE) AS u, (y + pad)/((hi + pad*2)/31.0::DOUBLE) AS v FROM (
    SELECT pm25 AS x, target AS y, hi, hi*1e-9 AS pad FROM panel, (SELECT quantile_cont(pm25, 0.999) AS hi FROM panel WHERE target IS NOT NULL) WHERE target IS NOT NULL AND pm25 <= hi AND target <= hi))))) GROUP BY 1, 2, 3"""


@query("correction_hexbins", sql(HEX, "panel"))
def correction_hexbins(i):
    return reports.correction_hexbins(panel(i))


@query("daily_means", sql(out("SELECT date, AVG(target) AS target, AVG(pm25) AS pm25 FROM panel GROUP BY 1", "target pm25"), "panel"))
def daily_means(i):
    return reports.daily_means(panel(i), ["target", "pm25"])


@query("bias_histogram", sql(out("""SELECT bin, lo + bin*width AS "left", COUNT(*) AS n FROM (SELECT least(floor((v - lo)/width), 39)::INT AS bin, lo, width FROM (SELECT v, lo, (hi - lo)/40.0::DOUBLE AS width FROM b, (SELECT MIN(v) AS lo, MAX(v) AS hi FROM b))) GROUP BY bin, lo, width""", '"left"', ""),
    "panel", b="SELECT pm25 - target AS v FROM panel WHERE target IS NOT NULL"))
def bias_histogram(i):
    return reports.histogram(panel(i).withColumn("bias", F.col("pm25") - F.col("target")), "bias")


@query("axis_limit", sql(out("""SELECT COUNT(v) AS n, quantile_cont(v, 0.995) AS "limit" FROM (SELECT unnest([target, pm25]) AS v FROM panel)""", '"limit"', ""), "panel"))
def axis_limit(i):
    return reports.axis_limits(panel(i), ["target", "pm25"])


@query("busiest_sensor_month", sql(out("""SELECT sensor_id, date, pm25 FROM panel WHERE (sensor_id, date_trunc('month', date)) IN (SELECT (sensor_id, m) FROM (SELECT sensor_id, date_trunc('month', date) AS m, COUNT(*) AS c FROM panel GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 1))""", "pm25"), "panel"))
def busiest_sensor_month(i):
    return reports.busiest_sensor_month(panel(i)).select("sensor_id", "date", "pm25").orderBy("date")


@query("feature_coverage", sql(out("""SELECT * FROM (SELECT unnest(['humidity', 'target']) AS feature, unnest([COUNT(humidity)/COUNT(*), COUNT(target)/COUNT(*)]) AS coverage FROM panel) WHERE coverage < 1""", "coverage", ""), "panel"))
def feature_coverage(i):
    return features.feature_coverage(panel(i), ["humidity", "target", "temperature"])


def fold_map(i):
    p = cut_lineage(panel(i).select("sensor_id", "date", "lat", "lon"))
    return reports.block_map(p, folds.sensor_folds(p).withColumnRenamed("fold", "block"))


@query("block_map", sql(out("SELECT DISTINCT sensor_id, lat, lon, fold::INT AS block FROM folded", "lat lon", ""), "folded"))
def block_map(i):
    return fold_map(i)


@query("block_counts", sql("""SELECT fold::INT AS block, COUNT(*) AS n_sensors, row_number() OVER (ORDER BY COUNT(*) DESC, fold) = 1 AS is_largest FROM folds GROUP BY fold""", "folds"))
def block_counts(i):
    return reports.block_counts(fold_map(i))


@query("block_hulls")
def block_hulls(i):
    return reports.block_hulls(fold_map(i))


@query("metrics_report", sql(out(f"""SELECT 'by_day' AS section, metric, value, row_number() OVER (ORDER BY metric)::INT AS "row" FROM (
 SELECT CAST(date AS VARCHAR) || '.' || k AS metric, CASE k WHEN 'r2' THEN r2 WHEN 'rmse' THEN rmse WHEN 'mae' THEN mae WHEN 'bias' THEN bias ELSE n::DOUBLE END AS value
 FROM (SELECT date, {REGRESSION} FROM (SELECT date, target AS y, pm25 AS p FROM panel WHERE target IS NOT NULL) GROUP BY 1), (SELECT unnest(['r2', 'rmse', 'mae', 'bias', 'n', 'rmse2']) AS k) WHERE k <> 'rmse2') QUALIFY "row" <= 160""", "value", ""), "panel"))
def metrics_report(i):
    wide = metrics.regression_metrics(panel(i), "target", "pm25", ["date"])
    return sinks.summary_rows(sinks.flat_metrics(wide, "by_day", ["r2", "rmse", "mae", "bias", "n"], ["date"]))
