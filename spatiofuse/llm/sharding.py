"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are range-partitioned by id; each partition's bytes and rows are summed, and
the sums of the partitions before it give every row its place in one global order.
A row goes to the shard that its middle byte falls into when all bytes are cut at
equal targets, so shards are contiguous and differ by less than their largest row.

Defined results: a null text has no bytes; null ids come first; rows of equal id are
ordered by text hash and may lie in two shards; repeated rows take a slot each;
added columns begin with ``_s_`` or are ``shard`` and ``slot``; an empty table gives
an empty table. Ties never gather in one task: the range bounds cover the hash and
a row number too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatiofuse.llm.staging import staged

SHARDS, ROW_BYTES = 24, 8


def row_size(text: Column) -> Column:
    """Bytes of a row: its text's UTF-8 bytes and a fixed part."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def sharded(table: DataFrame, order: list[str], size: str = "size", shards: int = SHARDS) -> DataFrame:
    """``table`` with shard (0 .. shards-1) and slot (gapless from 0 in the shard) by the order of ``order``."""
    key = [*order, "_s_row"]
    rows = staged(table.withColumn("_s_row", F.monotonically_increasing_id()), "shard-rows")  # numbers are kept by writing
    ranged = staged(rows.repartitionByRange(*key).withColumn("_s_part", F.spark_partition_id()), "shard-ranges")
    # one row for each partition, at most as many as the session's shuffle partitions
    totals = ranged.groupBy("_s_part").agg(F.sum(size).alias("_s_bytes"), F.count(F.lit(1)).alias("_s_n"))
    earlier = W.orderBy("_s_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "_s_part", F.coalesce(F.sum("_s_bytes").over(earlier), F.lit(0)).alias("_s_byte0"),
        F.coalesce(F.sum("_s_n").over(earlier), F.lit(0)).alias("_s_rank0"),
        F.sum("_s_bytes").over(W.orderBy("_s_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_s_total"))
    within = W.partitionBy("_s_part").orderBy(*key)
    before = F.coalesce(F.sum(size).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = (ranged.withColumns({"_s_before": before, "_s_rank": F.row_number().over(within) - 1})
              .join(F.broadcast(starts), "_s_part")
              .withColumns({"_s_middle": 2 * (F.col("_s_byte0") + F.col("_s_before")) + F.col(size), "_s_rank": F.col("_s_rank0") + F.col("_s_rank")})
              .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(_s_middle * {shards}) div (2 * _s_total)")).cast("int")))
    placed = staged(placed.select(*table.columns, "shard", "_s_rank"), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("_s_rank").alias("_s_first"))  # ``shards`` rows
    return (placed.join(F.broadcast(firsts), "shard")
            .select(*table.columns, "shard", (F.col("_s_rank") - F.col("_s_first")).cast("long").alias("slot")))


def write_shards(table: DataFrame, path: str, order: list[str], size: str = "size", shards: int = SHARDS) -> None:
    """Write the rows, in slot order, as one folder for each shard."""
    done = sharded(table, order, size, shards)
    done.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Narrow rows (id, size, text_crc32, hash) that stand for the documents while places are found."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), row_size(F.col(text)).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("hash"))
