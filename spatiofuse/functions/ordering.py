"""Reproducible pseudo-random order and whole-table ranks without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffle_key(seed: int | str, *columns) -> Column:
    """Hex text whose order is a seeded shuffle of the given key columns."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_int(key: Column) -> Column:
    """Non-negative integer below 2^32 from a shuffle key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def whole_rank(df: DataFrame, key: str, out: str = "rn") -> DataFrame:
    """1-based rank of every row by the hex text column ``key`` (unique per row).

    The first three hex digits split the rows into 4,096 even buckets. Bucket
    totals (at most 4,096 rows) give each bucket its starting rank, and only the
    rows of one bucket are ordered together, so no task sees the whole table.
    """
    bucketed = df.withColumn("_bucket", F.substring(F.col(key), 1, 3))
    totals = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy("_bucket").orderBy(key)
    return (bucketed.join(F.broadcast(starts), "_bucket")  # at most 4,096 rows
            .withColumn(out, F.col("_start") + F.row_number().over(within))
            .drop("_bucket", "_start"))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep one row per key under an explicit order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def capped_per_key(df: DataFrame, keys: list[str], seed, identity: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows per key in seeded order (a sampling operator)."""
    w = W.partitionBy(*keys).orderBy(shuffle_key(seed, *identity))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")


def sampled(df: DataFrame, n: int, seed, identity: list[str]) -> DataFrame:
    """Seeded sample of ``n`` rows (distributed top-n by shuffle key)."""
    return (df.withColumn("_key", shuffle_key(seed, *identity))
            .orderBy("_key").limit(n).drop("_key"))
