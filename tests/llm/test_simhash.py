import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from spatiofuse.llm import simhash
from spatiofuse.llm.components import components
from tests.llm.conftest import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_print(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return Counter((d, f"{p:016x}", ids.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def got(docs, **more):
    return Counter((r["id"], r["f"], r["component_id"]) for r in simhash.grouped(docs, **more).withColumn("f", simhash.hex_digits(F.col("fp"))).collect())


def test_fixture_matches_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in table(folder, "documents")])


def test_edges(spark, make_docs):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (6, "two words"), (None, "two words"), (None, "alone here now"), (7, long), (8, long + " end"),
            (9, "É é straße A"), (10, "x y z w")]
    docs = make_docs([(i, t, "s") for i, t in rows]).withColumn("fp", F.lit("x")).withColumn("least", F.lit(0)).withColumn("key", F.lit(0))
    assert got(docs) == brute(rows)
    assert simhash.grouped(make_docs([])).count() == 0


def test_chains_lose_no_link(spark):
    """Random pairs at every distance, joined by small blocks too."""
    rng, edges, prints = random.Random(11), set(), set()
    for _ in range(400):
        base = rng.getrandbits(64)
        other = base
        for b in rng.sample(range(64), rng.randint(0, 5)):
            other ^= 1 << b
        prints |= {base, other}
        if (base ^ other).bit_count() in (1, 2, 3):
            edges.add(frozenset((base, other)))
    centre = rng.getrandbits(64)
    cloud = {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12, 24)}  # a crowded key
    prints |= cloud
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in prints], "fp long")
    for block in (1024, 16):
        root = {r["a"]: r["b"] for r in components(simhash.links(df, block)).collect()}
        for e in edges:
            a, b = map(signed, e)
            assert root.get(a, a) == root.get(b, b)
        assert len({root.get(signed(v), signed(v)) for v in cloud}) == 1
        n = len({root.get(signed(v), signed(v)) for v in prints})
        assert n == len(prints) - len(edges) - len(cloud) + 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7000, 6000), (6000, 7000)]
    root = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root[i] == 0 for i in range(1, 201)) and all(root[1000 + i] == 1000 for i in range(1, 300)) and root[7000] == 6000 and 6000 not in root


def test_no_join_sends_a_growing_table_to_the_driver(spark, make_docs, monkeypatch):
    """Files of a few MB hold, after an explode, rows of hundreds of MB; the planner would broadcast them."""
    from spatiofuse.llm import components as stars
    from spatiofuse.llm import jaccard, lines

    plans = []

    def seen(df, name, kept=simhash.staged):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    for module in (simhash, stars, jaccard, lines):
        monkeypatch.setattr(module, "staged", seen)
    docs = make_docs([(i, f"one two three four {i // 2} five six seven. ", "s") for i in range(20)])
    ends = [simhash.grouped(docs), jaccard.grouped(docs), lines.deduplicated(docs)]
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in ends]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
