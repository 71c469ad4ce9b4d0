import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatiofuse.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    counted = [(i, Counter(tokens(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in items:
        asked, scored = set(tokens(text)), []
        for i, c in counted:
            m = 50 + 50 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        rows += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(rows, key=str)


def got(spark, docs, items, k=50):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"q": F.lit(1), "item": F.lit("x"), "score": F.lit(0)}).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit(1))
    return sorted((tuple(r) for r in lexical.search(frame, asked, k).select("item", "rank", "id", "score").collect()), key=str)


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 60)) if x < 400)) for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"DOCUMENTS": 64, "STRETCH": 1}, {"POSTINGS": 500, "STRETCH": 3, "ITEM_TERMS": 5}])
def test_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    docs = corpus(900) + [(None, "w1 w2 É9"), (5000, None), (5001, ""), (5002, "-- !"), (5003, "W1 " * 200_000 + "w77"), (3, "w1 w2 w3"), (3, "w1 w2 w3")] + [(6000 + i, "w5 copies w6") for i in range(120)]
    items = [(1, "w1 w2 w3 W1"), (2, "w5 w6 copies"), (2, "w300 w20"), (None, "é9 É9 w1"), (4, None), (5, ""), (6, "absent"), (7, " ".join(f"w{i}" for i in range(200)))]
    for k in (1, 50):
        assert got(spark, docs, items, k) == brute(docs, items, k)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == [] and got(spark, [(1, "a")], []) == [] and got(spark, [(1, None)], [(1, "a")]) == []


def test_stops_early():
    """A list with a clear head is not read to its end, and the result is that of all documents."""
    n = 40_000
    lengths, times = np.full(n, 50), np.ones(2 * n, np.int64)
    times[:200] = 1000 - np.arange(200)
    block = lexical.Block(np.arange(n), np.zeros(n, bool), lengths, np.full(n, 2), np.tile([0, 1], n), times, n, 50 * n, np.array([3000, 2000]))
    best = lexical.Best(10)
    met = block.search(np.array([0, 1]), best)
    assert met < n / 20 and best.ids.tolist() == list(range(10))
    assert not block.met.any() and not block.marked.any() and not block.asked.any()


def test_direct_accesses_move_the_best_position():
    """Documents met in one list close gaps in another, so its bound falls below its last read position."""
    n = 1_000
    lengths, times = np.full(n, 10), np.repeat(np.arange(n, 0, -1), 2)
    block = lexical.Block(np.arange(n), np.zeros(n, bool), lengths, np.full(n, 2), np.tile([0, 1], n), times, n, 10 * n, np.array([1000, 1000]))
    best = lexical.Best(3)
    assert block.search(np.array([0, 1]), best) <= lexical.STRETCH and best.ids.tolist() == [0, 1, 2]
