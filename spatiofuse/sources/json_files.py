"""Large JSON files as many rows in many tasks.

The text source cuts a file at a separator byte wherever its blocks lie, so no task
reads a whole file. What a fragment means depends on what stands before it: whether a
string is open there, and how deep in brackets it lies. Both are running totals: they
are summed inside each block, and the totals of the blocks before are added (one row
a block). Fragments that a separator inside a string cut apart are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatiofuse.session import cut_lineage

_PLACE = ["file", "block", "seq"]


def _quotes(text: Column) -> Column:
    """Quotes that open or close a string: those not escaped."""
    plain = F.regexp_replace(text, r"\\.", "")
    return F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))


def _running(df: DataFrame, amount: str, out: str) -> DataFrame:
    """``out``: sum of ``amount`` over all fragments of the file before this one."""
    blocks = df.groupBy("file", "block").agg(F.sum(amount).alias("_total"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    blocks = blocks.select("file", "block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return (df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(blocks, ["file", "block"])
            .withColumn(out, F.col("_start") + F.col("_inside")).drop("_start", "_inside"))


def _depth_change(text: Column, in_string: Column) -> Column:
    """Brackets opened less closed outside strings."""
    plain = F.regexp_replace(F.concat(F.when(in_string, F.lit('"')).otherwise(F.lit("")), text), r"\\.", "")
    bare = F.regexp_replace(F.regexp_replace(plain, '"[^"]*"', ""), '"[^"]*$', "")
    count = lambda chars: F.length(bare) - F.length(F.translate(bare, chars, ""))
    return count("{[") - count("}]")


def fragments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, seq, text, last, depth): pieces between structural separators, with the bracket depth before each.

    ``separator`` is ``,`` or ``}``; it is left out of ``text``. ``last`` marks what follows the file's last separator.
    """
    raw = (spark.read.option("lineSep", separator).text(path)
           .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))
    raw = cut_lineage(raw.withColumn("seq", F.monotonically_increasing_id()))  # increases inside a block
    ends = raw.groupBy("file").agg(F.max(F.struct("block", "seq")).alias("_end"))
    raw = raw.join(ends, "file").withColumn("last", F.struct("block", "seq") == F.col("_end")).drop("_end")
    counted = _running(raw.withColumn("_q", _quotes(F.col("text"))), "_q", "_before")
    counted = counted.withColumn("_open", F.col("_before") % 2 == 1).drop("_q", "_before")
    # a fragment that begins inside a string continues the one before
    joined = _running(counted.withColumn("_new", F.when(F.col("_open"), 0).otherwise(1)), "_new", "_group")
    joined = joined.withColumn("_group", F.col("_group") + F.col("_new"))
    whole = joined.groupBy("file", "_group").agg(
        F.min(F.struct("block", "seq")).alias("_at"), F.max("last").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))), lambda x: x["text"]), separator).alias("text"))
    whole = whole.select("file", F.col("_at.block").alias("block"), F.col("_at.seq").alias("seq"), "text", "last")
    closing = F.when(F.col("last"), 0).otherwise(-1) if separator == "}" else F.lit(0)
    whole = cut_lineage(whole.withColumn("change", _depth_change(F.col("text"), F.lit(False)) + closing))
    return _running(whole, "change", "depth")


def _following(df: DataFrame, value: str) -> DataFrame:
    """Replace NULLs of ``value`` by the last one before in the file."""
    blocks = df.groupBy("file", "block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq"))).alias("_last"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (df.withColumn("_inside", F.last(value, ignorenulls=True).over(inside)).join(blocks, ["file", "block"])
            .withColumn(value, F.coalesce("_inside", "_carried")).drop("_inside", "_carried"))


_STRING = r'"(?:[^"\\]|\\.)*"'
_OPENER = r"^[\s{]*(" + _STRING + r")\s*:\s*\{"
_ENTRY = r"^[\s{]*(?:" + _STRING + r"\s*:\s*\{\s*)?(" + _STRING + r")\s*:\s*(" + _STRING + r"|[^\s{}\[\]\",]+)[\s}]*$"


def map_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, key, value) of files ``{"section": {"key": scalar, ...}, ...}``; values as JSON text."""
    parts = fragments(spark, path, ",")
    parts = _following(parts.withColumn("section", F.when(F.col("text").rlike(_OPENER), F.regexp_extract("text", _OPENER, 1))), "section")
    bare = lambda c: F.expr(f"substr({c}, 2, length({c}) - 2)")
    found = parts.filter(F.col("text").rlike(_ENTRY) & F.col("section").isNotNull())
    found = found.select("file", "section", F.regexp_extract("text", _ENTRY, 1).alias("key"), F.regexp_extract("text", _ENTRY, 2).alias("value"))
    return found.select("file", bare("section").alias("section"), bare("key").alias("key"), "value")


def array_objects(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, index, value): the objects of the array ``name`` at the top level of each file, as JSON text."""
    opener = '"' + name + r'"\s*:\s*\['
    parts = fragments(spark, path, "}").filter(~F.col("last")).withColumn("_mark", F.col("text").rlike(opener).cast("int"))
    parts = _running(parts, "_mark", "_marked")
    # from the array's opening on, an object of it ends where the depth falls from three ({ [ {) to two
    ends = (F.col("_marked") + F.col("_mark") > 0) & (F.col("depth") + F.col("change") == 2)
    parts = _running(parts.withColumn("_done", ends.cast("int")), "_done", "index")
    whole = parts.groupBy("file", "index").agg(
        F.max("_done").alias("_done"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))), lambda x: F.concat(x["text"], F.lit("}"))), "").alias("value"))
    head = F.regexp_replace("value", r"(?s)^.*?" + opener + r"\s*", "")
    value = F.when(F.col("index") == 0, head).otherwise(F.regexp_replace("value", r"^[\s,]+", ""))
    # what follows the array does not begin with an object
    return whole.filter("_done = 1").select("file", F.col("index").cast("long").alias("index"), value.alias("value")).filter(F.col("value").startswith("{"))
