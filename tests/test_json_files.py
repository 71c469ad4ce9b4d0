"""Large JSON files in pieces: the same rows as a whole-file parser, wherever the blocks are cut."""

import json

import pytest
from pyspark.sql import functions as F

from spatiofuse.sources import json_files, sinks


@pytest.fixture(params=["128m", "200b"])
def small_blocks(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], "1b")
    yield request.param
    for n, b in zip(names, before):
        spark.conf.set(n, b)


AWKWARD = ['a, b', 'x } y', '{"in": [1]}', 'quote " here', 'back \\', '\\"', 'é ü', '', 'line\nbreak', '],[', '":{']


def test_map_entries(spark, tmp_path, small_blocks):
    docs = [{"sensors": {f"{i}": i * 1.5 if i % 3 else None for i in range(n)} | {a: a for a in AWKWARD}, "empty": {}, "tracts": {f"t{i}": a for i, a in enumerate(AWKWARD * n)}} for n in (1, 40)]
    want = []
    for i, d in enumerate(docs):
        for indent in (None, 1):
            (tmp_path / f"{i}{indent}.json").write_text(json.dumps(d, indent=indent, ensure_ascii=False))
            want += [(section, k, v) for section, entries in d.items() for k, v in entries.items()]
    got = json_files.map_entries(spark, str(tmp_path)).collect()
    key = lambda t: json.dumps(t)
    assert sorted(((r["section"], json.loads(f'"{r["key"]}"'), json.loads(r["value"])) for r in got), key=key) == sorted(want, key=key)
    assert small_blocks != "200b" or json_files.fragments(spark, str(tmp_path), ",").select("block").distinct().count() > 5


def test_array_objects(spark, tmp_path, small_blocks):
    def collection(n, head):
        return {**head, "features": [{"type": "Feature", "properties": {"note": AWKWARD[i % len(AWKWARD)], "deep": {"er": [{"x": i}, {}]}}, "geometry": {"coordinates": [[i, 1.5], [2, 3]]}} for i in range(n)]}
    files = [collection(30, {"type": "FeatureCollection", "crs": {"properties": {"name": "p"}}}), collection(1, {}) | {"after": {"a": {"b": 1}, "c": {"d": [{"e": 2}]}}}, {"type": "FeatureCollection", "features": []}]
    for i, d in enumerate(files):
        (tmp_path / f"{i}.geojson").write_text(json.dumps(d, indent=2 if i == 1 else None, ensure_ascii=False) + ("\n" if i else ""))
    got = json_files.array_objects(spark, str(tmp_path), "features").collect()
    found = {(r["file"][-9], r["index"]): json.loads(r["value"]) for r in got}
    assert found == {(str(i), k): f for i, d in enumerate(files) for k, f in enumerate(d["features"])}


def test_reload_guard(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).repartition(7)
    path = str(tmp_path / "f")
    sinks.write_frame(df, path, keys=["k"])
    assert sinks.manifest(spark, path)["n"] == 500 and sinks.manifest(spark, str(tmp_path / "none")) is None
    assert sinks.reload_frame(spark, path, df.orderBy("k"), ["k"]).count() == 500
    for other, differences in ((df.unionByName(df.filter("k = 3")), (0, 1)), (df.filter("k <> 3"), (1, 0)), (df.withColumn("k", F.when(F.col("k") == 3, 4).otherwise(F.col("k"))), (1, 1)), (df.withColumn("k", F.expr("nullif(k, 3)")), (1, 1))):
        with pytest.raises(sinks.FrameMismatch) as e:
            sinks.reload_frame(spark, path, other, ["k"])
        assert (e.value.differences["only_left"], e.value.differences["only_right"]) == differences
    df.unionByName(df.filter("k = 3")).write.mode("overwrite").parquet(path)  # behind the manifest's back
    with pytest.raises(sinks.FrameMismatch):
        sinks.reload_frame(spark, path, spark.read.parquet(path), ["k"])
    pair = spark.createDataFrame([(1,), (1,)], "k long")
    assert sinks.key_checksum(pair, ["k"]).first() != sinks.key_checksum(pair.limit(0), ["k"]).first()  # equal rows cancel in the xor alone
