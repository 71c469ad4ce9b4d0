"""Quantiles, metrics, folds, blending, conformal and kriging: properties and edge cases."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatiofuse.functions import scalar as S
from spatiofuse.functions.quantiles import exact_quantiles
from spatiofuse.operators import blend, bootstrap, conformal, folds, kriging, metrics, reports, variogram
from spatiofuse.operators.blend import Gram


def test_quantiles_with_a_hot_value(spark):
    """A third of the rows share one value; two keys; NULLs ignored."""
    rng = np.random.default_rng(1)
    vals = {k: np.concatenate([np.full(400, 5.0), rng.normal(k * 10, 3, 800)]) for k in (0, 1)}
    rows = [(k, float(v)) for k, vs in vals.items() for v in vs] + [(0, None), (1, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = {r.k: r for r in exact_quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.999}, ["k"]).collect()}
    for k, vs in vals.items():
        assert np.allclose([got[k].a, got[k].b, got[k].c], np.quantile(vs, [0.25, 0.5, 0.999]))
        assert got[k].n == 1200


def test_aqi_edges(spark):
    edges = [9.0, 9.04, 9.1, 35.4, 35.49, 35.5, 225.4, 225.5, -1.0]
    df = spark.createDataFrame([(v,) for v in edges], "v double")
    assert [r[0] for r in df.select(S.aqi_category("v")).collect()] == [0, 0, 1, 1, 1, 2, 4, 5, 0]


def test_pixel_snap_rounds_half_to_even_and_flags_outside(spark):
    df = spark.createDataFrame([(0.5, 1.5), (1.5, 0.0), (-0.6, 0.0), (None, 0.0), (9.6, 0.0)], "lat double, lon double")
    got = df.select(*[e.alias(k) for k, e in S.pixel_index("lat", "lon", 0.0, 0.0, 1.0, 10, 10).items()]).collect()
    assert [(r.row, r.col, r.pixel) for r in got] == [(0, 2, 2), (2, 0, 20), (None,) * 3, (None,) * 3, (None,) * 3]


def test_long_text_is_not_cut_by_padding(spark):
    df = spark.createDataFrame([("7",), ("123456",)], "t string")
    assert [r[0] for r in df.select(S.zero_padded("t", 3)).collect()] == ["007", "123456"]


def test_metrics_degenerate_inputs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "y double, p double")
    flat = metrics.regression_metrics(df, "y", "p").first()
    assert flat.r2 is None and flat.n == 2 and flat.bias == 1.5
    empty = metrics.regression_metrics(df.filter("y > 5"), "y", "p").first()
    assert empty.n == 0 and empty.rmse is None
    aqi = metrics.aqi_metrics(df, "y", "p").first()
    assert aqi.exceedance_precision is None and aqi.exceedance_recall is None and aqi.macro_f1 == 1.0


def plane(spark, fn, n=8):
    rows = [(i * n + j, dt.date(2024, 1, 1), 30 + i * 0.1, -97 + j * 0.1, float(fn(i, j))) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "sensor_id long, date date, lat double, lon double, residual double")


def test_moran_sign(spark):
    assert metrics.morans_by_day(plane(spark, lambda i, j: i + j)).first().morans_i > 0.5
    assert metrics.morans_by_day(plane(spark, lambda i, j: (i + j) % 2), k=4).first().morans_i < -0.5
    assert metrics.morans_by_day(plane(spark, lambda i, j: 1.0)).first().morans_i is None
    assert metrics.morans_by_day(plane(spark, lambda i, j: i, n=3)).count() == 0


def test_folds_are_disjoint_and_near_equal(spark):
    ids = spark.range(103).withColumnRenamed("id", "sensor_id")
    sizes = sorted(r["count"] for r in folds.sensor_folds(ids, 10).groupBy("fold").count().collect())
    assert sizes == [10] * 7 + [11] * 3
    assert folds.sensor_folds(ids.limit(4), 10).select("fold").distinct().count() == 4
    held = folds.held_out_ids(ids, "sensor_id", 0.25)
    assert held.count() == 26


def gram(p, y):
    return Gram(len(y), p.sum(0), y.sum(), p.T @ p, p.T @ y, y @ y)


def test_simplex_weights_beat_a_grid():
    rng = np.random.default_rng(3)
    y = rng.normal(10, 3, 500)
    p = np.column_stack([y + rng.normal(0, s, 500) for s in (1.0, 2.0, 8.0)])
    w = blend.simplex_weights(gram(p, y), 3)
    assert w.min() >= 0 and abs(w.sum() - 1) < 1e-12
    loss = ((p @ w - y) ** 2).mean()
    for a in np.linspace(0, 1, 41):
        for b in np.linspace(0, 1 - a, 41):
            assert loss <= ((p @ [a, b, 1 - a - b] - y) ** 2).mean() + 1e-9


def test_simplex_edge_cases():
    y = np.arange(10.0)
    same = np.column_stack([y + 1, y + 1])
    assert abs(blend.simplex_weights(gram(same, y), 2).sum() - 1) < 1e-12
    assert blend.simplex_weights(None, 2).tolist() == [0.5, 0.5]
    assert blend.simplex_weights(gram(y[:, None], y), 1).tolist() == [1.0]


def test_ridge_matches_projected_descent():
    rng = np.random.default_rng(5)
    y = rng.normal(10, 3, 300)
    p = np.column_stack([y + rng.normal(0, 1, 300), -y + rng.normal(0, 1, 300), rng.normal(0, 1, 300)])
    s = blend.ridge_stack(gram(p, y), ["a", "b", "c"])
    pc, yc = p - p.mean(0), y - y.mean()
    w = np.zeros(3)
    step = 1.0 / (np.linalg.norm(pc, 2) ** 2 + 1)
    for _ in range(20000):
        w = np.maximum(0, w - step * (pc.T @ (pc @ w - yc) + w))
    assert np.allclose(s.coef, w, atol=1e-6)
    assert abs(s.intercept - (y.mean() - p.mean(0) @ w)) < 1e-5
    with pytest.raises(ValueError):
        blend.ridge_stack(gram(p[:5], y[:5]), ["a", "b", "c"])


@pytest.mark.parametrize("n,delta", [(9, 8.0), (10, 9.0), (37, 35.0)])
def test_conformal_order_statistic(spark, n, delta):
    df = spark.range(n).select(F.col("id").cast("double").alias("target"), F.lit(-1000.0).alias("lo"), F.lit(0.0).alias("hi"))
    assert conformal.conformal_delta(df).first().delta == delta


def test_conformal_coverage(spark):
    rng = np.random.default_rng(8)
    rows = [(float(v), -1.0, 1.0, bool(i % 2)) for i, v in enumerate(rng.normal(0, 2, 4000))]
    df = spark.createDataFrame(rows, "target double, lo double, hi double, cal boolean")
    d = conformal.conformal_delta(df.filter("cal")).first().delta
    out = df.filter("NOT cal").withColumns({"lo": F.col("lo") - d, "hi": F.col("hi") + d})
    assert abs(metrics.interval_coverage(out, "target", "lo", "hi").first().coverage - 0.9) < 0.03


def test_bootstrap_single_cluster_uses_rows(spark):
    rows = [(1, dt.date(2024, 1, d), float(d), float(d) + (-1) ** d) for d in range(1, 29)]
    df = spark.createDataFrame(rows, "sensor_id long, date date, y double, p double")
    ci = bootstrap.bootstrap_ci(df, "y", "p", "sensor_id", n_boot=100).first()
    assert ci.r2_lo is not None and ci.r2_lo < ci.r2_hi and abs(ci.rmse_lo - 1.0) < 1e-9


def test_kriging_weights_are_exact_at_points_and_sum_to_one():
    rng = np.random.default_rng(2)
    lat, lon = rng.uniform(28, 32, (5, 12)), rng.uniform(-99, -95, (5, 12))
    model = np.tile([2.0, 1.5, 0.0], (5, 1))
    w = kriging.local_weights(lat, lon, lat[:, 3], lon[:, 3], model)
    assert np.allclose(w, np.eye(12)[[3] * 5], atol=1e-6)
    w = kriging.local_weights(lat, lon, np.full(5, 30.1), np.full(5, -97.2), model + [0, 0, 0.3])
    assert np.allclose(w.sum(axis=1), 1.0)
    lag = np.linspace(0.1, 3, 6)
    sill, reach, nugget = kriging.fit_variogram(lag, kriging.exponential(lag, 2.0, 1.8, 0.5))
    assert abs(sill - 2.0) < 0.2 and abs(reach - 1.8) < 0.3 and abs(nugget - 0.5) < 0.2


def binned_pairs(points, box):
    """Lag, semivariance and number of pairs of each bin, pair by pair."""
    cell = box["side"] / variogram.CELLS
    sets = {}
    for a in range(len(points)):
        for b in range(a):
            (y, x, v), (y2, x2, v2) = [((p[0] - box["lat"]), (p[1] - box["lon"]) * np.cos(np.radians(box["lat"])), p[2]) for p in (points[a], points[b])]
            at = lambda size: tuple(sorted(tuple(int(np.floor((c + box["side"] / 2) / size)) for c in p) for p in ((y, x), (y2, x2))))
            cells = at(cell)
            key = at(cell / variogram.SUBCELLS) if cells[0] == cells[1] else cells
            n, dd, g = sets.get((cells[0] == cells[1], key), (0, 0.0, 0.0))
            sets[(cells[0] == cells[1], key)] = n + 1, dd + (y - y2) ** 2 + (x - x2) ** 2, g + 0.5 * (v - v2) ** 2
    bins = {}
    for n, dd, g in sets.values():
        k = int(np.sqrt(dd / n) / (box["side"] / 3) * variogram.LAGS)
        if k < variogram.LAGS:
            bins[k] = np.add(bins.get(k, 0), (n, dd, g))
    out = np.array([bins[k] for k in sorted(bins)])
    return np.sqrt(out[:, 1] / out[:, 0]), out[:, 2] / out[:, 0], out[:, 0]


def test_variogram_bins_are_all_pairs(spark):
    rng = np.random.default_rng(11)
    rows = [(dt.date(2024, 1, 1 + i % 2), float(rng.choice([29.0, 29.1, rng.uniform(28, 33)])), float(rng.uniform(-99, -95)), float(rng.normal()), i % 3) for i in range(150)]
    df = spark.createDataFrame([*rows, (dt.date(2024, 1, 1), None, 1.0, 2.0, 0), (dt.date(2024, 1, 1), 30.0, -97.0, None, 0)], "date date, lat double, lon double, v double, fold int")
    box = variogram.extent(df)
    for fold in (None, "fold"):
        got = variogram.variogram_bins(df, "v", fold).orderBy("bin").collect()
        for d in {r[0] for r in rows}:
            for f in (range(3) if fold else [None]):
                mine = [r for r in got if r["date"] == d and (f is None or r["fold"] == f)]
                want = binned_pairs([r[1:4] for r in rows if r[0] == d and (f is None or r[4] != f)], box)
                for column, values in zip(("lag", "gamma", "pairs"), want):
                    assert np.allclose([r[column] for r in mine], values, atol=1e-9)
    assert variogram.variogram_bins(df.limit(0), "v").count() == 0
    assert variogram.variogram_bins(df.filter("lat = 29.0").limit(1), "v").count() == 0


def test_a_planted_range_is_recovered(spark):
    """Values drawn with an exponential covariance: the fitted range is within a fifth, averaged over days."""
    rng = np.random.default_rng(5)
    n, reach, days = 260, 1.5, 12
    lat, lon = rng.uniform(28, 33, n), rng.uniform(-100, -94.5, n)
    d = kriging.arc_degrees(lat[:, None], lon[:, None], lat, lon)
    root = np.linalg.cholesky(4.0 * np.exp(-3.0 * d / reach) + 1e-9 * np.eye(n))
    rows = [(dt.date(2024, 1, 1 + t), float(lat[i]), float(lon[i]), float(v)) for t in range(days) for i, v in enumerate(root @ rng.normal(size=n))]
    bins = variogram.variogram_bins(spark.createDataFrame(rows, "date date, lat double, lon double, v double"), "v").toPandas()
    found = [kriging.fit_variogram(*(part.sort_values("lag")[c].to_numpy(float) for c in ("lag", "gamma", "pairs")))[1] for _, part in bins.groupby("date")]
    assert abs(np.mean(found) / reach - 1) < 0.2


def test_poisson_weights_resample_like_picks(spark):
    """Mean and variance of a weight, independence of draws, and the interval of a plain cluster bootstrap."""
    keys = np.random.default_rng(0).integers(0, bootstrap.PRIME, 4000)
    w = bootstrap.weights(keys, bootstrap.draw_constants(200, 7))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06
    rng = np.random.default_rng(1)
    y = rng.normal(20, 6, 600)
    p = y + rng.normal(0, 3, 600) + np.repeat(rng.normal(0, 2, 60), 10)
    df = spark.createDataFrame([(i // 10, dt.date(2024, 1, 1 + i % 10), float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "sensor_id long, date date, y double, p double")
    got = bootstrap.bootstrap_ci(df, "y", "p", "sensor_id").first()
    draws = []
    for _ in range(1000):
        at = (rng.integers(0, 60, 60)[:, None] * 10 + np.arange(10)).ravel()
        draws.append((1 - ((p[at] - y[at]) ** 2).sum() / ((y[at] - y[at].mean()) ** 2).sum(), np.sqrt(((p[at] - y[at]) ** 2).mean())))
    want = np.quantile(np.array(draws), [0.025, 0.975], axis=0)
    width = want[1] - want[0]
    assert np.allclose([got.r2_lo, got.rmse_lo], want[0], atol=0.2 * width.max()) and np.allclose([got.r2_hi, got.rmse_hi], want[1], atol=0.2 * width.max())
    assert got.n_boot == 1000


def test_draws_pick_as_many_clusters_as_there_are(spark):
    """Every draw holds exactly C picks of whole clusters; Poisson weights hold about as many."""
    clusters = spark.range(1, 38).select(F.col("id").alias("slot"), (F.col("id") * 7919).alias("key"), F.lit(1.0).alias("one"), F.col("id").cast("double").alias("at"))
    picked = bootstrap._resampled(clusters, ["one", "at"], 120, 3, poisson=False).toPandas()
    assert sorted(picked.b) == list(range(120)) and (picked.one == 37).all()
    for b in (0, 49, 50, 119):
        want = sum(int(hashlib.md5(f"3:{b}:{s}".encode()).hexdigest()[:8], 16) % 37 + 1 for s in range(1, 38))
        assert picked[picked.b == b]["at"].item() == want
    assert not (bootstrap._resampled(clusters, ["one"], 120, 3, poisson=True).toPandas().one == 37).all()


def test_local_kriging_against_brute_force(spark):
    """Every training row can serve; held-out folds never do; few neighbours fall back to inverse distances."""
    rng = np.random.default_rng(4)
    day = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    rows = []
    for s in range(60):
        la, lo = float(rng.uniform(28, 32)), float(rng.uniform(-99, -95))
        for d in day[:2]:
            if d == day[0] or s % 20 == 0:  # the second day has three sensors: inverse-distance fallback
                rows.append((s, d, la, lo, float(la + rng.normal(0, 0.1)), s % 3))
    rows.append((100, day[2], 30.0, -97.0, 5.0, 1))  # nothing to learn from on the third day
    df = spark.createDataFrame(rows, "sensor_id long, date date, lat double, lon double, target double, fold int")
    got = {(r[0], r[1]): r[2] for r in kriging.kriging_baseline(df, neighbors=10).collect()}
    assert len(got) == len(rows) and got[(100, day[2])] is None

    def near(fold, d, la, lo):
        pool = [r for r in rows if r[1] == d and r[5] != fold]
        return sorted(pool, key=lambda r: (kriging.arc_degrees(la, lo, r[2], r[3]), r[0]))[:10]

    box = variogram.extent(df)
    for f in range(3):  # the day's variogram over all pairs of the other folds
        mine = [r for r in rows if r[1] == day[0] and r[5] == f]
        lists = {r[0]: near(f, day[0], r[2], r[3]) for r in mine}
        lag, gamma, pairs = binned_pairs([r[2:5] for r in rows if r[1] == day[0] and r[5] != f], box)
        model = np.array([kriging.fit_variogram(lag, gamma, pairs)])
        for r in mine:
            p = np.array([[o[2:5] for o in lists[r[0]]]])
            w = kriging.local_weights(p[:, :, 0], p[:, :, 1], np.array([r[2]]), np.array([r[3]]), model)
            assert abs(got[(r[0], day[0])] - max(0.0, float((w * p[:, :, 2]).sum()))) < 1e-6
    for r in rows:
        if r[1] == day[1]:
            pool = near(r[5], day[1], r[2], r[3])
            w = [1 / np.radians(kriging.arc_degrees(r[2], r[3], o[2], o[3])) ** 2 for o in pool]
            want = sum(a * o[4] for a, o in zip(w, pool)) / sum(w) if pool else None
            assert (got[(r[0], day[1])] is None and want is None) or abs(got[(r[0], day[1])] - want) < 1e-6
    resid = {(r[0], r[1]): r[2] for r in kriging.residual_kriging(df.withColumn("p", F.lit(30.0)), "p").collect()}
    assert resid[(100, day[2])] == 0.0


def test_hull_of_slices_is_the_hull(spark):
    rng = np.random.default_rng(6)
    pts = rng.normal(0, 1, (400, 2))
    df = spark.createDataFrame([(i, 0, float(x), float(y)) for i, (x, y) in enumerate(pts)], "sensor_id long, block int, lon double, lat double")
    got = {(round(r.lon, 9), round(r.lat, 9)) for r in reports.block_hulls(df, pad=0.0).collect()}
    assert got == {(round(x, 9), round(y, 9)) for x, y in reports.hull(pts)}


def test_early_stopping_tail_size(spark):
    rows = [(s, dt.date(2024, 1, 1 + d)) for s in range(50) for d in range(30)]
    df = folds.early_stopping_tail(spark.createDataFrame(rows, "sensor_id long, date date"))
    tail = df.filter("is_tail")
    assert df.count() == 1500 and tail.count() == 150
    assert tail.agg(F.min("date")).first()[0] == dt.date(2024, 1, 28)
    small = folds.early_stopping_tail(spark.createDataFrame(rows[:150], "sensor_id long, date date"))
    assert small.filter("is_tail").count() == 0
