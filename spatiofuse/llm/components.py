"""Connected components of an edge table, by alternating large and small stars.

Each round is two joins and two aggregations over the edges; every round's edges
are staged in the shared folder, so lineage stays short and nothing but one
checksum row reaches the driver. The number of rounds grows with the logarithm of
a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatiofuse.llm.staging import dealt, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(dealt(least), F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(dealt(least.select(F.col("a").alias("of"), "m")), F.col("a") == F.col("of")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _checksum(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that has an edge to another, except the least of its component, with that least node.

    ``edges`` has long columns a and b without nulls; loops and repeated edges are allowed.
    """
    current = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _checksum(current)
    while before[0]:
        current = staged(_small_star(_large_star(current)), "edges")
        after = _checksum(current)
        if after == before:
            break
        before = after
    return current
