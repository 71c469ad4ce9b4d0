import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spatiofuse.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights=(3, 1, 2), percent=150, most=2):
    """Targets by sharing again what is over a source's limit, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, stopped = sum(sizes.values()) * percent / 100, set()
    while True:
        free = [s for s in names if s not in stopped]
        rest = budget - sum(most * sizes[s] for s in stopped)
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in stopped else w[s] * level for s in names}
        stopped |= over


def rows_of(n=3_000):
    rows = [(i, " ".join(["w"] * (1 + i * i % 211)), ("a", "b", "é", "Z", None)[i % 5 if i % 3 else 0], "x") for i in range(n)]
    rows += [(None, "null id", "a", "x"), (-1, None, "a", "x"), (-2, "", "b", "x"), (-3, " \n ", "c", "x"), (-4, "w\t" * 30_000, "b", "x")]
    return rows + [(9_000_000, "hot copy of words", "a", "x")] * 700


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(5)


def check(rows, done):
    """Whole result: a row for each row, targets by brute force, copies of floor or ceiling, words near the target."""
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    aims, taken, longest = shares(sizes), Counter(), defaultdict(int)
    for r in done:
        expect = aims[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert r["target"] == pytest.approx(aims[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert int(expect) <= r["copies"] <= -int(-expect // 1) or abs(expect - round(expect)) < 1e-9
        assert r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert Counter((r["id"], r["source"], r["size"]) for r in done) == Counter((i, s, len(WORD.findall(t or ""))) for i, t, s, _ in rows)
    return {s: abs(taken[s] - aims[s]) for s in sizes}, longest


def test_whole_result_and_reruns(spark):
    rows = rows_of()
    done = mixing.by_row(mixing.mixed(frame(spark, rows))).collect()
    missed, longest = check(rows, done)
    assert all(m <= longest[s] / 2 + 1e-6 for s, m in missed.items())
    assert missed["a"] <= 10  # many short documents: the last residual is short
    again = mixing.by_row(mixing.mixed(frame(spark, rows[::-1]).repartition(2))).collect()
    assert Counter(map(tuple, done)) == Counter(map(tuple, again))


def test_levels_of_the_tree(spark):
    """Small groups make several levels; sums and bounds hold all the same."""
    rows = rows_of(1_500)
    missed, longest = check(rows, mixing.by_row(mixing.mixed(frame(spark, rows), fan=4, reserve=2)).collect())
    assert all(m <= longest[s] / 2 + 1e-6 for s, m in missed.items())


def test_expectation(spark):
    """Over many seeds a document is taken in proportion to its probability, whatever its size."""
    parts = [(b"%03d" % i, 5 + i % 40, 0.3 * (5 + i % 40)) for i in range(120)]
    rows = spark.createDataFrame([("a", bytes(k), s, m) for k, s, m in parts], "source string, key binary, size long, mass double").cache()
    hits, seeds = Counter(), 20
    for seed in range(seeds):
        done = mixing.rounded(rows, fan=8, reserve=4, seed=seed).collect()
        assert len(done) == len(parts) and abs(sum(r["extra"] * dict((k, s) for k, s, _ in parts)[bytes(r["key"])] for r in done) - sum(m for *_, m in parts)) <= 22.5
        for r in done:
            hits[bytes(r["key"])] += r["extra"]
    small, large = ([hits[k] / seeds for k, s, _ in parts if (s < 25) == low] for low in (True, False))
    assert abs(sum(small) / len(small) - 0.3) < 0.06 and abs(sum(large) / len(large) - 0.3) < 0.06
    rows.unpersist()


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 5, "z": 300, None: 70}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(shares(sizes))
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_empty_and_mixture(spark):
    empty = frame(spark, [])
    assert mixing.by_row(mixing.mixed(empty)).count() == 0
    rows = rows_of(200)
    mix = mixing.mixture(frame(spark, rows).withColumn("key", F.lit(1)))
    total = mix.agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")) * F.col("copies"))).first()[0]
    assert mix.columns == ["doc_id", "text", "source", "size", "key", "copies"]
    assert total == mixing.by_row(mixing.mixed(frame(spark, rows))).agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
