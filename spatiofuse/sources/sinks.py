"""Sinks with checks: frames, metrics tables, prediction files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatiofuse.functions.scalar import null_if_not_finite


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of keys found only on one side (0, 0 when two frames hold the same rows)."""
    left = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("na"))
    right = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb"))
    both = left.join(right, keys, "full").select(
        F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    return both.agg(
        F.coalesce(F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))), F.lit(0)).alias("only_right"),
        F.coalesce(F.sum(F.least("na", "nb")), F.lit(0)).alias("shared"))


def key_checksum(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row that tells whether two frames hold the same keys equally often, in whatever order.

    Count, sum and xor of two hashes of the key: a lost, changed or repeated row
    changes them, and they come from one scan without a shuffle of rows.
    """
    hashes = [F.xxhash64(*keys), F.xxhash64(F.lit("second"), *keys)]
    parts = [F.count(F.lit(1)).alias("n")]
    for i, h in enumerate(hashes, 1):
        parts += [F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias(f"sum{i}"), F.coalesce(F.bit_xor(h), F.lit(0)).alias(f"xor{i}")]
    return df.agg(*parts)


def manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}.manifest"


def write_frame(df: DataFrame, path: str, partition_by: list[str] | None = None, keys: list[str] | None = None) -> None:
    """Write a frame, and with ``keys`` the manifest that reloading checks."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if keys:
        written = df.sparkSession.read.schema(df.schema).parquet(path)
        key_checksum(written, keys).withColumn("keys", F.lit(",".join(keys))).write.mode("overwrite").parquet(manifest_path(path))


class FrameMismatch(ValueError):
    """Keys of a stored frame and of its folds differ; ``differences`` says how many."""

    def __init__(self, what: str, differences: dict):
        super().__init__(f"{what}: {differences}")
        self.differences = differences


def reload_frame(spark: SparkSession, path: str, folds: DataFrame, keys: list[str]) -> DataFrame:
    """Read a frame back and refuse it when its keys differ from the frozen folds' keys.

    The checksums of frame and folds (one scan each) are compared with each other
    and, where the frame was written with one, with its manifest. Keys are joined
    only to say what differs.
    """
    df = spark.read.parquet(path)
    found = key_checksum(df, keys).first().asDict()
    if found != key_checksum(folds, keys).first().asDict():
        raise FrameMismatch("frame and folds disagree", key_differences(df, folds, keys).first().asDict())
    stored = manifest(spark, path)
    if stored and stored.pop("keys") == ",".join(keys) and stored != found:
        raise FrameMismatch("frame is not as it was written", {"written": stored["n"], "found": found["n"]})
    return df


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The checksum stored with a frame; None where it was written without."""
    try:
        return spark.read.parquet(manifest_path(path)).first().asDict()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def flat_metrics(metrics: DataFrame, section: str, names: list[str], prefix: list[str] | None = None) -> DataFrame:
    """Long (section, metric, value) rows with dotted names from a wide metrics table."""
    prefix = prefix or []
    entries = F.array(*[F.struct(F.lit(n).alias("k"), null_if_not_finite(n).alias("v")) for n in names])
    metric = F.concat_ws(".", *[F.col(p).cast("string") for p in prefix], F.col("e.k"))
    return (metrics.select(*prefix, F.explode(entries).alias("e"))
            .select(F.lit(section).alias("section"), metric.alias("metric"), F.col("e.v").alias("value")))


def summary_rows(flat: DataFrame) -> DataFrame:
    """All rows of each report section, numbered in metric order."""
    w = W.partitionBy("section").orderBy("metric")
    return flat.withColumn("row", F.row_number().over(w))


def metrics_json(flat: DataFrame) -> DataFrame:
    """Strict JSON text of every metric of each section (one document per section, as the report asks)."""
    entry = F.struct("metric", "value")
    return (flat.groupBy("section").agg(F.sort_array(F.collect_list(entry)).alias("e"))
            .select("section", F.to_json(F.map_from_entries("e"), {"ignoreNullFields": "false"}).alias("json")))


def with_second_tier(rows: DataFrame, second: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Replace ``column`` of a prediction table by the second tier's values."""
    return rows.drop(column).join(second.select(*keys, column), keys, "left")


def write_documents(rows: DataFrame, path: str) -> None:
    """Text files, one for each ``file`` of (file, part, line), with its lines in the order of part and text.

    Rows are dealt by a hash of ``file``: a repartition by the column itself is planned away above a union
    whose parts are dealt by it, and those parts are then coalesced apart, which cuts a file in two.
    """
    (rows.repartition(F.xxhash64("file")).sortWithinPartitions("file", "part", "line").select("file", "line")
     .write.mode("overwrite").partitionBy("file").text(path))
