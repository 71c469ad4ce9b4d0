import hashlib
import math
import re
import zlib

from pyspark.sql import functions as F

from spatiofuse.llm import importance, terms

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    """Rows (id, n_features, weight, score, rank) by plain counting."""
    def counted(texts):
        out = [0] * buckets
        for t in texts:
            for f in runs(t, longest)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out
    s, t = counted([x for _, x in docs]), counted(target)
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        n, found = runs(text, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(spark, docs, target, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit("x"), "features": F.lit(1), "_r_row": F.lit(7)})
    done = importance.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), **options)
    return sorted((tuple(r) for r in done.select("id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_brute_force(spark):
    docs = [(i, " ".join(f"Word{(i * j) % 37}é, x{j % 5}" for j in range(i % 60))) for i in range(300)]
    docs += [(None, None), (1000, ""), (1001, "...  \n"), (7, "same id " * 30), (7, "same id " * 30), (None, "tie " * 25), (1002, "long " * 400_000), (1003, "Ünïcode 1a" + "z" * 50_000)]
    target = ["word1é x1 word2é", None, "", "Long same"]
    assert got(spark, docs, target) == brute(docs, target)
    assert got(spark, docs, target, longest=3, buckets=70_000, min_words=3, percent=50, seed=5) == brute(docs, target, 3, 70_000, 3, 50, 5)


def test_empty_tables(spark):
    assert got(spark, [], ["a b"]) == []
    assert got(spark, [(1, "a " * 25), (2, "b")], [], percent=100) == brute([(1, "a " * 25), (2, "b")], [], percent=100)


def test_ties_take_the_smaller_id(spark):
    docs = [(3, "a " * 20)] * 40 + [(2, "a " * 20)] * 40
    rows = [r for r in got(spark, docs, ["a"], percent=50) if r[4]]
    assert sorted(r[4] for r in rows) == list(range(1, 41)) and rows == [r for r in brute(docs, ["a"], percent=50) if r[4]]


def test_spans_and_slices():
    scans = importance.patterns(3)
    line = terms.collapsed("A-b  ç,d".encode())
    assert line.decode() == "a b ç d"
    assert [[m.group().decode() for m in s.finditer(line, overlapped=True)] for s in scans] == [["a", "b", "ç", "d"], ["a b", "b ç", "ç d"], ["a b ç", "b ç d"]]
    text = ("wörd, " * 500_000).encode()
    assert terms.collapsed(text) == b" ".join(["wörd".encode()] * 500_000)
    assert len(list(terms.term_slices(text))) > 2 and list(terms.term_slices(None)) == []


def test_drawn_documents(spark):
    docs = spark.createDataFrame([(i, ("near " if i < 10 else "far ") * 25, i) for i in range(100)], "doc_id long, text string, rank long")
    kept = importance.drawn_documents(docs, spark.createDataFrame([("near " * 9,)], "text string"), percent=10)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(10))
