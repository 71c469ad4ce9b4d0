import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatiofuse.llm import cover_tree as ct
from spatiofuse.llm.catalog import QUERIES, op1
from tests.llm.conftest import table

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, k=10):
    use = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in use if i % 100 == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in use if i != q)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_fixture(spark, folder):
    assert got(QUERIES["op1_exact_top_k"](spark, folder)) == brute([(r["vec_id"], r["embedding"]) for r in table(folder, "embeddings")])


def test_clusters_copies_and_edges(spark, monkeypatch):
    rng = random.Random(1)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, f32(c + rng.gauss(0, 0.05) for c in centres[i % 5])) for i in range(1, 1500)]
    rows += [(i, f32(centres[0])) for i in range(2000, 2900)]  # one vector very often
    rows += [(100_000, None), (100_100, []), (100_200, [1.0, None, 2.0]), (100_300, [float("nan")] * 6), (100_400, [float("inf")] * 6), (100_500, [1.0, -2.0]), (100_600, f32([0.0] * 6)),
             (None, [1.0] * 6), (-100, f32([-3.0, 2.5, 1e-9, 7.0, 0.1, 0.2])), (100_700, f32([1e6] * 6))]
    monkeypatch.setattr(ct, "DATA_BLOCK", 200)
    monkeypatch.setattr(ct, "QUERY_BLOCK", 8)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"block": F.lit("b"), "q": F.lit(1), "v": F.lit(2), "score": F.lit(3)})
    assert got(op1(df)) == brute(rows)


def test_few_and_none(spark):
    few = [(0, [1.0, 2.0]), (100, [0.5, 0.5]), (7, [3.0, 1.0])]
    assert got(op1(spark.createDataFrame([(*r, 0) for r in few], SCHEMA))) == brute(few)
    assert got(op1(spark.createDataFrame([(5, [1.0], 0)], SCHEMA))) == [] and got(op1(spark.createDataFrame([], SCHEMA))) == []


def test_search_prunes_and_bounds_hold():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(c, 3, (400, 4)) for c in (0, 300, 900)]).astype(np.int64)
    queries = rng.normal(900, 3, (40, 4)).astype(np.int64)
    q, p = ct.tree_of(queries), ct.tree_of(data)

    def walk(a, b):
        assert (queries[a.rows] @ data[b.rows].T).max() <= ct.bound(a, b)
        for x in a.children or [a]:
            for y in b.children:
                walk(x, y)

    walk(q, p)
    seen = []
    plain = ct.products
    ct.products = lambda a, b: seen.append(a.shape[0] * b.shape[0]) or plain(a, b)
    try:
        best = ct.search(queries, np.arange(40) + 10_000, data, np.arange(1200), 10)
    finally:
        ct.products = plain
    assert sum(seen) < 0.6 * len(queries) * len(data)
    for i in range(40):
        s = queries[i] @ data.T
        assert sorted(best.kept[i]) == sorted(sorted(((int(x), -j) for j, x in enumerate(s)), reverse=True)[:10])


def test_own_row_takes_no_place_in_a_leaf():
    """One leaf of 50 untied unit vectors, each of them a query: the query's own score is the largest."""
    rng = np.random.default_rng(9)
    real = rng.normal(0, 0.05, (50, 8)) + rng.normal(0, 1, 8)
    data = np.floor(real / np.linalg.norm(real, axis=1)[:, None] * 100_000).astype(np.int64)
    for ids in (np.arange(50), np.arange(50) // 2):  # the second with repeated ids
        best = ct.search(data, ids, data, ids, 10)
        for i in range(50):
            all_others = sorted(((int(data[i] @ data[j]), -int(ids[j])) for j in range(50) if ids[j] != ids[i]), reverse=True)
            assert sorted(best.kept[i], reverse=True) == all_others[:10]
