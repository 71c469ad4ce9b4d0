"""The quadtree engine of the nearest joins: exact against brute force, even under skew."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatiofuse.operators import nearest as K
from spatiofuse.operators import quadtree as Q

DAY = dt.date(2024, 1, 1)


def places(rng, n):
    """Land, a dense city, one shared address, both sides of the date line, and the poles."""
    city = np.column_stack([rng.normal(30.0, 0.01, n), rng.normal(-97.0, 0.01, n)])
    land = np.column_stack([rng.uniform(-80, 80, n // 4), rng.uniform(-180, 180, n // 4)])
    edge = [(0.0, 179.999), (0.0, -179.999), (89.9, 10.0), (89.9, -170.0), (-89.9, 0.0), (10.0, 180.0), (10.0, -180.0)]
    return [tuple(map(float, p)) for p in [*city, *land, *edge, *[(30.0, -97.0)] * 20]]


def brute(probes, pool, k, metric, same_group, eligible):
    """Ranked ids of each probe by a full comparison."""
    out = {}
    lat, lon = (np.array([p[c] for p in pool], float) for c in ("lat", "lon"))
    for q in probes:
        d = Q.arcs(q["lat"], q["lon"], lat, lon, metric)
        rows = sorted((round(float(x), 7), p["id"]) for x, p in zip(d, pool) if same_group(q, p) and eligible(q, p))
        out[tuple(q.values())] = (rows[:k], rows[:k + 1])  # one more, to know a tie at the end
    return out


def check(got, want, keys):
    found = {}
    for r in got.collect():
        found.setdefault(tuple(r[c] for c in keys), []).append((r["rank"], round(r["distance"], 7), r["p_id"]))
    for q, (rows, more) in want.items():
        mine = sorted(found.pop(q, []))
        assert [d for _, d, _ in mine] == pytest.approx([d for d, _ in rows], abs=2e-6)
        if len({d for d, _ in more}) == len(more):
            assert [i for *_, i in mine] == [i for _, i in rows]
    assert not found


@pytest.mark.parametrize("metric", ["haversine", "degree"])
def test_leaves_against_brute_force(spark, metric):
    rng = np.random.default_rng(7)
    pool = [{"date": DAY, "lat": a, "lon": b, "id": i, "side": i % 3} for i, (a, b) in enumerate(places(rng, 600))]
    probes = [{"date": DAY, "lat": a, "lon": b, "side": i % 3} for i, (a, b) in enumerate(dict.fromkeys(places(np.random.default_rng(8), 120)))]
    frame = spark.createDataFrame([tuple(p.values()) for p in pool], "date date, lat double, lon double, id long, side long")
    asked = spark.createDataFrame([tuple(p.values()) for p in probes], "date date, lat double, lon double, side long")
    for k, side in ((1, None), (5, "side"), (40, None)):
        keys = ["date", "lat", "lon"] + ([side] if side else [])
        mine = [{c: p[c] for c in keys} for p in probes]
        got = K._by_leaves(asked.select(keys).distinct(), frame, k, on=("date",), metric=metric, order=("id",), not_same=side)
        check(got, brute(mine, pool, k, metric, lambda q, p: True, lambda q, p: not side or q["side"] != p["side"]), keys)


def test_lists_of_places_and_what_they_leave_open(spark, monkeypatch):
    """Sensors by day: most probes settle in their list, others meet their group, by rows or by leaves."""
    rng = np.random.default_rng(3)
    sites = places(rng, 60)
    days = [DAY + dt.timedelta(d) for d in range(6)]
    pool = [{"date": d, "lat": a, "lon": b, "id": i, "fold": i % 4} for i, (a, b) in enumerate(sites) for d in days if (d == days[0] and i % 9 == 0) or (d != days[0] and rng.random() < 0.8)]
    probes = [{"date": d, "lat": a, "lon": b, "fold": 1} for a, b in dict.fromkeys(sites) for d in days]
    frame = spark.createDataFrame([tuple(p.values()) for p in pool], "date date, lat double, lon double, id long, fold long").withColumn("v", F.col("id") * 2)
    asked = spark.createDataFrame([tuple(p.values()) for p in probes], "date date, lat double, lon double, fold long")
    keys = ["date", "lat", "lon", "fold"]
    want = brute(probes, pool, 4, "haversine", lambda q, p: q["date"] == p["date"], lambda q, p: q["fold"] != p["fold"])
    for few in (K.FEW_PAIRS, 0):
        monkeypatch.setattr(K, "FEW_PAIRS", few)
        got = K.nearest(asked, frame, 4, not_same="fold")
        assert got.columns == [*keys, "p_lat", "p_lon", "p_id", "p_fold", "p_v", "distance", "rank"]
        check(got, want, keys)
    assert K.nearest(asked, frame.limit(0), 4, not_same="fold").count() == 0
    assert K.nearest(asked.limit(0), frame, 4, not_same="fold").count() == 0


def test_tiles_of_few_places_give_whole_lists(spark, monkeypatch):
    """Small tiles cut into parts: every probe has one list, nearest first, however far its rows lie; NULL sides and days."""
    monkeypatch.setattr(Q, "TILE_LEAVES", 1)
    monkeypatch.setattr(K, "TILE_PLACES", 3)
    monkeypatch.setattr(K, "FEW_PAIRS", 0)
    rng = np.random.default_rng(11)
    sites = places(rng, 90)
    days = [DAY + dt.timedelta(d) for d in range(5)]
    pool = [{"date": d, "lat": a, "lon": b, "id": i, "side": [None, "x", "y"][i % 3]} for i, (a, b) in enumerate(sites) for d in days if rng.random() < (0.05 if d == DAY else 0.7)]
    probes = [{"date": d, "lat": a, "lon": b, "side": s} for a, b in dict.fromkeys(sites) for d in days for s in (None, "y")]
    frame = spark.createDataFrame([tuple(p.values()) for p in pool], "date date, lat double, lon double, id long, side string")
    asked = spark.createDataFrame([tuple(p.values()) for p in probes] + [(None, 30.0, -97.0, "x")], "date date, lat double, lon double, side string")
    for metric in ("haversine", "degree"):
        want = brute(probes, pool, 3, metric, lambda q, p: q["date"] == p["date"], lambda q, p: q["side"] != p["side"])
        check(K.nearest(asked, frame, 3, metric=metric, not_same="side"), want, ["date", "lat", "lon", "side"])
    lists = K.nearest_lists(asked, frame, 3, not_same="side").collect()
    assert len({(r["date"], r["lat"], r["lon"], r["side"]) for r in lists}) == len(lists)
    assert all(e["distance"] == sorted(x["distance"] for x in r["_near"])[i] for r in lists for i, e in enumerate(r["_near"]))


def test_too_many_leaves_take_the_cells(spark, monkeypatch):
    monkeypatch.setattr(Q, "MOST_LEAVES", 3)
    pool = [{"date": DAY, "lat": a, "lon": b, "id": i} for i, (a, b) in enumerate(places(np.random.default_rng(1), 80))]
    frame = spark.createDataFrame([tuple(p.values()) for p in pool], "date date, lat double, lon double, id long")
    assert Q.build(frame, ["date"], "lat", "lon", "haversine") is None
    probes = [{"date": DAY, "lat": 30.0, "lon": -97.0}, {"date": DAY, "lat": 0.0, "lon": 180.0}]
    asked = spark.createDataFrame([tuple(p.values()) for p in probes], "date date, lat double, lon double")
    check(K.nearest(asked, frame, 3), brute(probes, pool, 3, "haversine", lambda q, p: True, lambda q, p: True), ["date", "lat", "lon"])


def test_a_city_is_split_and_a_leaf_is_small(spark):
    """All places in one city: leaves stay small, and no probe looks at more than a few of them."""
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), i) for i, (a, b) in enumerate(zip(rng.normal(30, 0.05, 8000), rng.normal(-97, 0.05, 8000)))]
    frame = spark.createDataFrame(rows, "lat double, lon double, id long").repartition(8)
    tree = Q.build(frame, [], "lat", "lon", "haversine")
    shared = spark.sparkContext.broadcast(tree)
    leaf = frame.select(Q.leaf_column(shared, [], "lat", "lon").alias("leaf")).groupBy("leaf").count()
    assert leaf.filter("leaf < 0").count() == 0
    assert leaf.agg(F.max("count")).first()[0] <= Q.CAPACITY and leaf.count() > 8000 / Q.CAPACITY
    tasks = frame.select(F.explode(Q.candidate_leaves(shared, [], "lat", "lon", 8)).alias("leaf")).repartition(16, "leaf").groupBy(F.spark_partition_id()).count()
    sizes = sorted(r["count"] for r in tasks.collect())
    assert sizes[-1] < 5 * sizes[len(sizes) // 2]


def test_cells_by_product(spark):
    sites = spark.createDataFrame([(30.0, -97.0), (None, -97.0), (10.0, 179.9)], "lat double, lon double")
    a = spark.createDataFrame([(30.1, -97.0), (31.0, -97.0), (10.0, 170.0)], "clat double, clon double")
    b = spark.createDataFrame([(0.0, 0.0)], "lat double, lon double")
    got = {(r["product"], r["lat"]): (r["clat"], r["clon"]) for r in K.nearest_cells(sites, {"a": (a, "clat", "clon"), "b": (b, "lat", "lon")}).collect()}
    assert got == {("a", 30.0): (30.1, -97.0), ("a", 10.0): (10.0, 170.0), ("b", 30.0): (0.0, 0.0), ("b", 10.0): (0.0, 0.0)}
