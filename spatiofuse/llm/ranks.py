"""Places of rows in one global order, without a global sort in one task.

Rows are dealt to ranges of the order; a range's count, added to those of the
ranges before it, gives every row its place. Rows equal in all order columns are
told apart by a row number, so a large group of ties spreads over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatiofuse.llm.staging import staged


def placed(rows: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """``rows`` with ``out``, from 1 in the given order. Added columns begin with ``_r_``."""
    numbered = staged(rows.withColumn("_r_row", F.monotonically_increasing_id()), "rank-rows")  # numbers are kept by writing
    keys = [*order, F.col("_r_row")]
    ranged = staged(numbered.repartitionByRange(*keys).withColumn("_r_part", F.spark_partition_id()), "rank-ranges")
    # one row for each range: at most the session's shuffle partitions
    counts = ranged.groupBy("_r_part").agg(F.count(F.lit(1)).alias("_r_n"))
    earlier = W.orderBy("_r_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_r_part", F.coalesce(F.sum("_r_n").over(earlier), F.lit(0)).alias("_r_before"))
    within = F.row_number().over(W.partitionBy("_r_part").orderBy(*keys))
    return (ranged.withColumn("_r_place", within).join(F.broadcast(starts), "_r_part")
            .select(*rows.columns, (F.col("_r_before") + F.col("_r_place")).cast("long").alias(out)))
