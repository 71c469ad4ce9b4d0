"""Range and nearest joins against brute force, on skewed hand-made fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spatiofuse.operators import nearest as K
from spatiofuse.operators import neighbors as N

SCHEMA = "sensor_id long, date date, lat double, lon double, target double, fold int"


def hav(la, lo, lb, mb):
    la, lo, lb, mb = map(np.radians, (la, lo, lb, mb))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((mb - lo) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def network(seed=0, n=70, days=3):
    """Sensors with one hot cluster holding a third of the rows, copies of one place, and NULL targets."""
    rng = np.random.default_rng(seed)
    lat, lon = rng.uniform(28, 32, n), rng.uniform(-99, -95, n)
    third = n // 3
    lat[:third], lon[:third] = 30 + rng.normal(0, 0.02, third), -97 + rng.normal(0, 0.02, third)
    lat[:6], lon[:6] = 30.0, -97.0  # copies of one place
    rows = []
    for d in range(days):
        for s in range(n):
            v = None if (s + d) % 11 == 0 else float(np.round(rng.gamma(2, 8), 3))
            rows.append((s, dt.date(2024, 1, 1 + d), float(lat[s]), float(lon[s]), v, s % 4))
    rows.append((999, dt.date(2024, 2, 1), 30.0, -97.0, 7.0, 1))  # alone on its day
    return pd.DataFrame(rows, columns=["sensor_id", "date", "lat", "lon", "target", "fold"])


def brute(query, pool):
    out = {}
    grand = pool.target.mean()
    for q in query.itertuples():
        p = pool[(pool.date == q.date) & pool.target.notna()]
        d = hav(q.lat, q.lon, p.lat.to_numpy(), p.lon.to_numpy())
        other = (p.sensor_id != q.sensor_id).to_numpy()
        vals = {r: p.target.to_numpy()[other & (d <= r)] for r in (25, 50, 100)}
        if len(p) and not np.isnan(q.target):
            day = (p.target.sum() - q.target) / max(len(p) - 1, 1)
        else:
            day = np.nan
        m50 = vals[50].mean() if len(vals[50]) else (day if not np.isnan(day) else grand)
        out[(q.sensor_id, q.date)] = [
            vals[25].mean() if len(vals[25]) else m50, len(vals[25]), m50, len(vals[50]),
            vals[50].std() if len(vals[50]) > 1 else 0.0, vals[100].mean() if len(vals[100]) else m50, len(vals[100])]
    return out


def check(df, want):
    got = {(r.sensor_id, r.date): [r.nbr_pm25_25km, r.nbr_count_25km, r.nbr_pm25_50km, r.nbr_count_50km,
                                   r.nbr_std_50km, r.nbr_pm25_100km, r.nbr_count_100km] for r in df.collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert np.allclose(got[key], values, atol=1e-7), (key, got[key], values)


@pytest.fixture(scope="module")
def pdf():
    return network()


@pytest.fixture(scope="module")
def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), SCHEMA).cache()


@pytest.mark.parametrize("limit", [10**6, 40])
def test_neighbors_match_brute_force(frame, pdf, limit):
    """Both the direct join and the level-by-level split give the brute-force answer."""
    check(N.with_neighbor_features(frame, pair_limit=limit), brute(pdf, pdf))


def test_lone_sensor_falls_back_to_zero(frame):
    row = N.with_neighbor_features(frame).filter("sensor_id = 999").first()
    assert row.nbr_pm25_50km == 0.0 and row.nbr_count_100km == 0 and row.nbr_std_50km == 0.0


def test_per_fold_merge_equals_direct_recompute(frame, pdf):
    """One pass over pool folds equals a separate join per held-out fold."""
    merged = N.neighbor_features_per_fold(frame, strict=False)
    for f in (0, 3):
        check(merged.filter(F.col("fold_out") == f), brute(pdf, pdf[pdf.fold != f]))


def test_held_out_values_do_not_leak(spark, frame, pdf):
    """Changing a held-out fold's readings leaves the features used for that fold unchanged."""
    moved = pdf.copy()
    moved.loc[moved.fold == 2, "target"] += 50.0
    other = spark.createDataFrame(moved.astype(object).where(moved.notna(), None), SCHEMA)

    def rows(df):
        return {(r.sensor_id, r.date): tuple(np.round(r[3:], 9)) for r in
                N.neighbor_features_per_fold(df).filter("fold_out = 2").collect()}
    assert rows(frame) == rows(other)


@pytest.mark.parametrize("metric", ["haversine", "degree"])
def test_nearest_matches_brute_force(frame, pdf, metric):
    k = 5
    pool = frame.filter("target IS NOT NULL").select("date", "lat", "lon", F.col("sensor_id").alias("id"), "fold")
    probes = frame.select("date", "lat", "lon", "fold").distinct()
    got = {}
    for r in K.nearest(probes, pool, k, metric=metric, not_same="fold").collect():
        got.setdefault((r.date, r.lat, r.lon, r.fold), {})[r.rank] = r.distance
    valid = pdf[pdf.target.notna()]
    for q in pdf.drop_duplicates(["date", "lat", "lon", "fold"]).itertuples():
        p = valid[(valid.date == q.date) & (valid.fold != q.fold)]
        d = hav(q.lat, q.lon, p.lat, p.lon) if metric == "haversine" else np.hypot(p.lat - q.lat, p.lon - q.lon)
        want = np.sort(d.to_numpy())[:k]
        have = [v for _, v in sorted(got.get((q.date, q.lat, q.lon, q.fold), {}).items())]
        assert np.allclose(have, want, atol=1e-9)


def test_nearest_wraps_and_keeps_short_groups(spark):
    pool = spark.createDataFrame([(1, 10.0, 179.9), (2, 10.0, -179.8), (3, 60.0, 0.0)], "id long, lat double, lon double")
    probe = spark.createDataFrame([(10.0, -179.99)], "lat double, lon double")
    found = K.nearest(probe, pool, 2, on=()).orderBy("rank").collect()
    assert [r.p_id for r in found] == [1, 2]
    assert len(K.nearest(probe, pool, 9, on=()).collect()) == 3


def test_nearest_other_skips_itself_among_copies(spark):
    rows = [(i, dt.date(2024, 1, 1), 30.0, -97.0) for i in range(12)] + [(50, dt.date(2024, 1, 1), 31.0, -97.0)]
    df = spark.createDataFrame(rows, "id long, date date, lat double, lon double")
    found = K.nearest_other(df, 3).collect()
    assert len(found) == 13 * 3
    assert all(r.id != r.p_id for r in found)
    assert all(r.distance == 0.0 for r in found if r.id != 50)


def test_nearest_cell_ties_and_absent_day(spark):
    product = spark.createDataFrame(
        [(30.0, -97.0, dt.date(2024, 1, 1), 1.0), (30.0, -96.0, dt.date(2024, 1, 1), 2.0), (31.0, -97.0, dt.date(2024, 1, 2), 3.0)],
        "cell_lat double, cell_lon double, date date, v double")
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 30.0, -96.5), (1, dt.date(2024, 1, 2), 30.0, -96.5)],
                               "id long, date date, lat double, lon double")
    got = {r.date.day: r.v for r in K.with_nearest_cell(df, product, ["v"], "cell_lat", "cell_lon").collect()}
    assert got == {1: 1.0, 2: None}


def test_own_reading_is_left_out_wherever_it_lies(spark):
    """A moved sensor, a reading that is not in the pool, and the compatible day mean."""
    day = dt.date(2024, 1, 1)
    query = spark.createDataFrame([("1", day, 30.0, -97.0, 30.0), ("9", day, 36.0, -106.0, 100.0)], "sensor_id string, date date, lat double, lon double, target double")
    pool = spark.createDataFrame([(1, day, 30.05, -97.0, 50.0), (2, day, 30.1, -97.0, 10.0), (3, day, 26.0, -94.0, 20.0)], "sensor_id long, date date, lat double, lon double, target double")
    got = {r.sensor_id: r for r in N.with_neighbor_features(query, pool, "target").collect()}
    assert got["1"].nbr_count_50km == 1 and abs(got["1"].nbr_pm25_50km - 10.0) < 1e-9
    assert got["9"].nbr_count_100km == 0 and abs(got["9"].nbr_pm25_50km - 80.0 / 3) < 1e-9
    compat = {r.sensor_id: r for r in N.with_neighbor_features(query, pool, "target", strict=False).collect()}
    assert abs(compat["9"].nbr_pm25_50km - (80.0 - 100.0) / 2) < 1e-9


def test_places_are_compared_once_for_all_days():
    """Sums of one group by matrix products, on days and keys that some places lack, against pairs; its own place never counts."""
    rng = np.random.default_rng(5)
    places = np.column_stack([rng.uniform(29, 30.5, 40), rng.uniform(-97, -95.5, 40)])
    unit = lambda a: np.column_stack([np.cos(np.radians(a[:, 0])) * np.cos(np.radians(a[:, 1])), np.cos(np.radians(a[:, 0])) * np.sin(np.radians(a[:, 1])), np.sin(np.radians(a[:, 0]))])
    rows = [(d, *places[i], *unit(places)[i], i % 2, 1 + i % 3, v := float(rng.normal()), v * v) for i in range(40) for d in range(5) if rng.random() < 0.7]
    p = pd.DataFrame(rows, columns=["date", "lat", "lon", "px", "py", "pz", "fold", "n", "s1", "s2"])
    q = p.iloc[::2][["date", "lat", "lon", "px", "py", "pz"]].set_axis(["date", "q_lat", "q_lon", "qx", "qy", "qz"], axis=1)
    got = N._matrix_sums((25.0, 50.0, 100.0), ["fold"])[0](q, p).set_index(["date", "q_lat", "q_lon", "fold"])
    pairs = q.merge(p, on="date")
    pairs["c2"] = sum((pairs[f"q{a}"] - pairs[f"p{a}"]) ** 2 for a in "xyz")
    pairs = pairs[(pairs.lat != pairs.q_lat) | (pairs.lon != pairs.q_lon)]
    for r in (25.0, 50.0, 100.0):
        want = pairs[pairs.c2 <= N._chord_sq(r)].groupby(["date", "q_lat", "q_lon", "fold"])[["n", "s1", "s2"]].sum()
        mine = got[got[f"n_{r:g}"] > 0]
        assert len(mine) == len(want) > 0
        for part in ("n", "s1") if r != 50.0 else ("n", "s1", "s2"):
            assert np.allclose(mine[f"{part}_{r:g}"].sort_index(), want[part].sort_index())


@pytest.mark.parametrize("extra", [[], ["fold"]])
def test_blocks_within_a_circle_are_not_compared_place_by_place(extra):
    """Four times the places on the same land: the sums are those of all pairs, the pairs compared grow less than sixteenfold."""
    def step(n):
        rng = np.random.default_rng(n)
        places = pd.DataFrame({"lat": 30 + rng.uniform(-0.9, 0.9, n), "lon": -95 + rng.uniform(-0.9, 0.9, n)})
        la, lo = np.radians(places["lat"]), np.radians(places["lon"])
        p = places.assign(date=dt.date(2024, 1, 1), px=np.cos(la) * np.cos(lo), py=np.cos(la) * np.sin(lo), pz=np.sin(la),
                          fold=np.arange(n) % 2, n=1, s1=rng.normal(size=n), s2=1.0)
        q = p.rename(columns={"lat": "q_lat", "lon": "q_lon", "px": "qx", "py": "qy", "pz": "qz"})[["date", "q_lat", "q_lon", "qx", "qy", "qz"]]
        got = N._matrix_sums((25.0, 50.0, 100.0), extra)[0](q, p)
        d = hav(q["q_lat"].to_numpy()[:, None], q["q_lon"].to_numpy()[:, None], p["lat"].to_numpy(), p["lon"].to_numpy())
        for fold, part in (got.groupby("fold") if extra else [(None, got)]):
            pool = p["fold"].to_numpy() == fold if extra else np.ones(n, bool)
            for r in (25, 50, 100):
                near = (d <= r) & (d > 0) & pool
                want = pd.DataFrame({"q_lat": q["q_lat"], "q_lon": q["q_lon"], "c": near.sum(1), "s": near @ p["s1"].to_numpy()})
                both = part.merge(want, on=["q_lat", "q_lon"])
                assert len(both) == len(part) and (both[f"n_{r}"] == both["c"]).all()
                assert np.allclose(both[f"s1_{r}"], both["s"], atol=1e-9)
        assert len(got) == n * (2 if extra else 1)
        asked, pool = (N.Blocks(places.to_numpy(), p[["px", "py", "pz"]].to_numpy()) for _ in range(2))
        return sum(np.isin(pool.block, np.flatnonzero(pool.met(asked, i, N._chord_sq(50.0) ** 0.5)[1])).sum() * N._BLOCK for i in range(len(asked.starts)))

    assert step(4000) < 11 * step(1000)


@pytest.mark.parametrize("extra", [[], ["fold"]])
def test_a_cell_goes_to_its_neighbours_in_few_bytes(extra):
    """Pool rows as bytes hold a place once for all its days, come back exactly, and give the sums that the rows give."""
    rng = np.random.default_rng(8)
    places = np.column_stack([rng.uniform(29, 30.5, 300), rng.uniform(-97, -95.5, 300)])
    rows = [(1, 2, 3, d, *places[i], i % 3, n, v, v * v if n == 1 else v * v + 1) for i in range(300) for d in range(20)
            if rng.random() < 0.9 and (n := 1 + (rng.random() < 0.05)) and (v := float(rng.normal()))]
    p = pd.DataFrame(rows, columns=["span", "pi", "pj", "date", "lat", "lon", "fold", "n", "s1", "s2"]).sample(frac=1, random_state=1)
    cells = N._packed(extra)((1, 2, 3), p)
    assert len(cells) == (3 if extra else 1) and cells["blob"].map(len).sum() < 24 * len(p)
    back = pd.concat([pd.DataFrame(spots[at], columns=["lat", "lon"]).assign(date=date, n=n, s1=s1, s2=s2) for spots, at, date, n, s1, s2 in map(N._from_bytes, cells["blob"])])
    by = ["lat", "lon", "date"]
    pd.testing.assert_frame_equal(back.sort_values(by, ignore_index=True), p[back.columns].sort_values(by, ignore_index=True), check_dtype=False, check_exact=True)
    q = p[p["date"] % 2 == 0].rename(columns={"lat": "q_lat", "lon": "q_lon"})[["date", "q_lat", "q_lon"]]
    run, keys = N._matrix_sums((25.0, 50.0, 100.0), extra)[0], ["date", "q_lat", "q_lon", *extra]
    pd.testing.assert_frame_equal(run(q, cells).sort_values(keys, ignore_index=True), run(q, p).sort_values(keys, ignore_index=True), check_dtype=False)


def test_rows_of_a_place_are_not_dealt_once_for_each_fold(spark, frame):
    """The totals of a place's folds travel as one row; copies for the held-out folds arise where they are used."""
    folded = frame.withColumn("fold", (F.col("sensor_id") % 3).cast("int"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = N.neighbor_features_per_fold(folded)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line and "q_lat" in line]
    assert dealt and not any("fold_out" in line for line in dealt)
