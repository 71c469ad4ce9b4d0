import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from spatiofuse.llm import sharding
from spatiofuse.llm.catalog import QUERIES
from tests.llm.conftest import table


def check(rows, sizes, shards=24):
    """Contiguous, gapless and near the equal target."""
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    total, largest = sum(sizes), max(sizes)
    for s, members in by.items():
        assert 0 <= s < shards and sorted(r["slot"] for r in members) == list(range(len(members)))
        assert abs(sum(r["size"] for r in members) - total / shards) <= largest + 1
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["id"] is None else r["id"] for r in order]
    assert ids == sorted(ids)


def test_fixture(spark, folder):
    rows = table(folder, "documents")
    got = QUERIES["op6_sharding"](spark, folder).withColumnRenamed("doc_id", "id").collect()
    want = {r["doc_id"]: (len(r["text"].encode()) + 8, zlib.crc32(r["text"].encode())) for r in rows}
    assert {r["id"]: (r["size"], r["text_crc32"]) for r in got} == want and len(got) == len(rows)
    check(got, [s for s, _ in want.values()])
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_edges(spark, make_docs):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x", "a"), (3, "é" * 5000, "a")] + [(7, f"tie {i % 3}", "a") for i in range(900)] + [(i, "w" * (i % 50), "b") for i in range(10, 700)]
    docs = make_docs(rows)
    got = sharding.sharded(sharding.document_sizes(docs).withColumn("rank", F.lit(1)), ["id", "hash"]).collect()
    assert len(got) == len(rows) and {(r["size"], r["text_crc32"]) for r in got if r["id"] in (1, 2)} == {(8, 0)}
    check(got, [r["size"] for r in got])
    assert sharding.sharded(sharding.document_sizes(make_docs([])), ["id", "hash"]).count() == 0


def test_files(spark, make_docs, tmp_path):
    docs = sharding.document_sizes(make_docs([(i, "t" * i, "a") for i in range(200)]))
    sharding.write_shards(docs, str(tmp_path / "out"), ["id", "hash"], shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4
