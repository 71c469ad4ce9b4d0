"""Validation battery: regression, strata, categories, decomposition, spatial autocorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiofuse import constants as C
from spatiofuse.functions.quantiles import exact_quantiles
from spatiofuse.functions.scalar import aqi_category, col_of
from spatiofuse.operators.nearest import nearest_other
from spatiofuse.session import cut_lineage


def scored(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())


def regression_aggs(y, pred) -> list[Column]:
    """r2, rmse, mae, bias (pred − y), n in one aggregation over complete pairs."""
    y, pred = col_of(y), col_of(pred)
    err = pred - y
    n = F.count(F.lit(1))
    total = F.var_pop(y) * n
    return [
        F.when(total > 0, F.lit(1.0) - F.sum(err * err) / total).alias("r2"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        F.avg(err).alias("bias"), n.alias("n"),
    ]


def regression_metrics(df: DataFrame, y: str, pred: str, by: list[str] | None = None, min_rows: int = 0) -> DataFrame:
    out = scored(df, y, pred).groupBy(*(by or [])).agg(*regression_aggs(y, pred))
    return out.filter(F.col("n") >= min_rows) if min_rows else out


def model_metrics(df: DataFrame, y: str, preds: list[str], by: list[str] | None = None) -> DataFrame:
    """Metrics per prediction column, in one pass over the table."""
    entries = F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).cast("double").alias("p")) for p in preds])
    long = df.select(*(by or []), F.col(y).alias("_y"), F.explode(entries).alias("e"))
    long = long.select(*(by or []), "_y", F.col("e.model").alias("model"), F.col("e.p").alias("_p"))
    return regression_metrics(long, "_y", "_p", [*(by or []), "model"])


def residual_columns(df: DataFrame, y: str, pred: str, site: str = "sensor_id") -> DataFrame:
    """Residual, bias and site anomalies of both sides."""
    ok = scored(df, y, pred)
    means = ok.groupBy(site).agg(F.avg(y).alias("_my"), F.avg(pred).alias("_mp"))
    return ok.join(means, site).withColumns({
        "residual": F.col(y) - F.col(pred), "bias": F.col(pred) - F.col(y),
        "y_anomaly": F.col(y) - F.col("_my"), "pred_anomaly": F.col(pred) - F.col("_mp")}).drop("_my", "_mp")


def spatial_temporal_r2(df: DataFrame, y: str, pred: str, site: str = "sensor_id") -> DataFrame:
    """Skill between sites (means) and within sites (anomalies)."""
    anomalies = residual_columns(df, y, pred, site)
    sites = scored(df, y, pred).groupBy(site).agg(F.avg(y).alias("y"), F.avg(pred).alias("p"))
    between = sites.agg(*regression_aggs("y", "p")).select(
        F.col("r2").alias("spatial_r2"), F.col("n").alias("n_sensors"), F.lit(1).alias("_j"))
    within = anomalies.agg(*regression_aggs("y_anomaly", "pred_anomaly")).select(
        F.col("r2").alias("temporal_r2"), "n", F.lit(1).alias("_j"))
    return between.join(within, "_j").drop("_j")  # one row each


def strata_metrics(df: DataFrame, y: str, pred: str, smoke: str = "hms_smoke", dust: str | None = "dust") -> DataFrame:
    """Metrics of the smoke, dust (above the exact P75) and clean strata; the first two may overlap."""
    is_smoke = F.coalesce(F.col(smoke).cast("double"), F.lit(0.0)) > 0
    is_dust = F.lit(False)
    if dust is not None:
        edge = exact_quantiles(df, dust, {"p75": 0.75}).select("p75").scalar()
        is_dust = F.coalesce(F.col(dust) > edge, F.lit(False))
    strata = F.array_compact(F.array(
        F.when(is_smoke, "smoke"), F.when(is_dust, "dust"), F.when(~is_smoke & ~is_dust, "clean")))
    return regression_metrics(df.withColumn("stratum", F.explode(strata)), y, pred, ["stratum"])


def dust_source(df: DataFrame, candidates: tuple[str, ...] = ("dust", "merra2_dust25")) -> str | None:
    """First candidate column holding any value (one aggregate)."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    counts = df.agg(*[F.count(c).alias(c) for c in present]).first()
    return next((c for c in present if counts[c] > 0), None)


def confusion(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Counts per (observed, predicted) category: at most 36 rows per group."""
    return (scored(df, y, pred).select(*(by or []), aqi_category(y).alias("ct"), aqi_category(pred).alias("cp"))
            .groupBy(*(by or []), "ct", "cp").agg(F.count(F.lit(1)).alias("c")))


def aqi_metrics(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Category accuracy, macro-F1 over observed categories, exceedance precision and recall."""
    cells = confusion(df, y, pred, by)

    def count(cond) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))

    ct, cp, hi = F.col("ct"), F.col("cp"), C.EXCEEDANCE_CATEGORY
    aggs = [count(F.lit(True)).alias("n"), count(ct == cp).alias("hit"),
            count((ct >= hi) & (cp >= hi)).alias("both"), count(cp >= hi).alias("flagged"),
            count(ct >= hi).alias("n_exceedance_true")]
    for k in range(len(C.AQI_CATEGORIES)):
        aggs += [count((ct == k) & (cp == k)).alias(f"tp{k}"), count(ct == k).alias(f"t{k}"), count(cp == k).alias(f"p{k}")]
    g = cells.groupBy(*(by or [])).agg(*aggs)
    # F1 of a class is 2·tp / (observed + predicted); classes never observed do not count
    f1 = [F.when(F.col(f"t{k}") > 0, 2.0 * F.col(f"tp{k}") / (F.col(f"t{k}") + F.col(f"p{k}")))
          for k in range(len(C.AQI_CATEGORIES))]
    total = sum((F.coalesce(f, F.lit(0.0)) for f in f1), F.lit(0.0))
    seen = sum(((F.col(f"t{k}") > 0).cast("int") for k in range(len(C.AQI_CATEGORIES))), F.lit(0))
    return g.select(
        *(by or []), F.when(F.col("n") > 0, F.col("hit") / F.col("n")).alias("category_accuracy"),
        F.when(seen > 0, total / seen).alias("macro_f1"),
        F.when(F.col("flagged") > 0, F.col("both") / F.col("flagged")).alias("exceedance_precision"),
        F.when(F.col("n_exceedance_true") > 0, F.col("both") / F.col("n_exceedance_true")).alias("exceedance_recall"),
        "n", "n_exceedance_true")


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    """6×6 matrix: one row per observed category with counts and row shares."""
    k = len(C.AQI_CATEGORIES)
    wide = (confusion(df, y, pred).groupBy("ct").pivot("cp", list(range(k))).agg(F.sum("c"))
            .select("ct", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"n{i}") for i in range(k)]))
    total = sum((F.col(f"n{i}") for i in range(k)), F.lit(0))
    return wide.withColumn("total", total).withColumns(
        {f"share{i}": F.col(f"n{i}") / F.col("total") for i in range(k)})


def exceedance_by_tier(df: DataFrame, y: str, preds: list[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(p).alias("tier"), F.col(p).cast("double").alias("p")) for p in preds])
    long = (df.select(F.col(y).alias("_y"), F.explode(entries).alias("e"))
            .select("_y", F.col("e.tier").alias("tier"), F.col("e.p").alias("_p")))
    return aqi_metrics(long, "_y", "_p", ["tier"]).select(
        "tier", "exceedance_precision", "exceedance_recall", "n_exceedance_true")


def interval_coverage(df: DataFrame, y: str, lo: str, hi: str, by: list[str] | None = None) -> DataFrame:
    ok = df.filter(F.col(y).isNotNull() & F.col(lo).isNotNull() & F.col(hi).isNotNull())
    return ok.groupBy(*(by or [])).agg(
        F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"),
        F.avg(F.col(hi) - F.col(lo)).alias("mean_width"), F.count(F.lit(1)).alias("n"))


def prior_column(df: DataFrame, column: str, offset: float | Column = 0.0) -> Column:
    """A prior product used as the prediction, optionally debiased; NULL when absent."""
    if column not in df.columns:
        return F.lit(None).cast("double")
    return F.col(column).cast("double") - (offset if isinstance(offset, Column) else F.lit(float(offset)))


def prior_offset(df: DataFrame, column: str, y: str = "target") -> DataFrame:
    """Mean of (prior − target) over complete pairs; pass training rows to keep it out of sample."""
    return scored(df, y, column).agg(F.avg(F.col(column) - F.col(y)).alias("prior_offset"), F.count(F.lit(1)).alias("n"))


def lag_neighbors(df: DataFrame, k: int = 8, on: tuple[str, ...] = ("date",), id_col: str = "sensor_id",
                  value: str = "residual") -> DataFrame:
    """k-nearest lag graph per day: (on, id, p_id, rank, p_value)."""
    return nearest_other(df.filter(F.col(value).isNotNull()), k, on=on, id_col=id_col, payload=(value,))


def morans_by_day(df: DataFrame, value: str = "residual", k: int = 8, min_sensors: int = 15,
                  id_col: str = "sensor_id") -> DataFrame:
    """Moran's I per day under row-standardised k-nearest weights; NULL without variance."""
    ok = df.filter(F.col(value).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    days = (ok.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_mean"))
            .filter(F.col("n") >= max(min_sensors, k + 2)))
    rows = ok.select("date", id_col, "lat", "lon", value).join(F.broadcast(days.select("date", "_mean")), "date")  # one row a day
    rows = cut_lineage(rows.withColumn("z", F.col(value) - F.col("_mean")).drop("_mean"))  # read three times
    lag = (nearest_other(rows, k, id_col=id_col, payload=("z",))
           .groupBy("date", "id").agg(F.avg("p_z").alias("lag")))
    joined = rows.withColumnRenamed(id_col, "id").join(lag, ["date", "id"])
    return (joined.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.sum(F.col("z") * F.col("z")) > 0,
               F.sum(F.col("z") * F.col("lag")) / F.sum(F.col("z") * F.col("z"))).alias("morans_i")))


def morans_summary(daily: DataFrame) -> DataFrame:
    """Mean, median, IQR and day count of the daily statistic (one value per day)."""
    v = daily.filter("morans_i IS NOT NULL")
    q = F.percentile("morans_i", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (v.agg(F.avg("morans_i").alias("mean"), q.alias("q"), F.count(F.lit(1)).alias("n_days"))
            .select("mean", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "n_days"))
