"""Column expressions on words and lines. A word is a run of characters other than space and \\t \\n \\v \\f \\r."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    inner = trimmed(F.coalesce(text, F.lit("")))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def has_word(text: Column) -> Column:
    return trimmed(text) != ""


def each(n: Column) -> Column:
    """0 .. n-1 as an array; empty for n < 1."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (n - 1).cast("int")))


def content_key(*columns: Column) -> Column:
    """16-byte key of the given values; nulls and empty strings differ."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))
