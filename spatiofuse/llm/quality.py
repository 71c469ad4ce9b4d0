"""Quality rules with cross-document line frequency (native DataFrame operations only).

A line is compared in normalised form: blanks trimmed, lower case, digit runs as
one 0. For each host the distinct documents that hold a line are counted (rows
with the same host and text are one document). A line is frequent on a host when
it is in more than ``max(min_docs, max_share * documents of the host)`` of them.
Frequent lines are removed; a document is depleted, and rejected, when lines were
removed and fewer than ``min_words`` words or ``min_left`` of its words are left.

Base rules reject texts under 50 words and texts in which over half of the words
lie in 3-word windows that the text holds more than once.

Defined results: null or empty text has no words and fails the base rules; a null
host is a host of its own; repeated rows get the same result each; columns beyond
those named are kept by ``apply_rules`` and never clash, as the operator's own
columns begin with ``_q_``; an empty table gives an empty table.

Scale: the counts shuffle one (host, hash) pair per distinct line and document,
combined before the shuffle. At most ``lines per document / max_share`` lines of a
host can be frequent. Texts move once, and only in ``apply_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiofuse.llm.staging import dealt, staged
from spatiofuse.llm.words import BLANK_RUN, BLANKS, content_key, each, has_word, trimmed, words

#: Production parameters.
MIN_DOCS, MAX_SHARE, MIN_WORDS, MIN_LEFT = 10, 0.10, 50, 0.30
#: Symbols counted by the base rules.
SYMBOLS = "#*$%&|<>"


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(F.lower(trimmed(line)), "[0-9]+", "0"))


def line_table(text: Column) -> Column:
    """(hash, words) of every line that has a word, in order."""
    return F.transform(F.filter(F.split(text, "\n"), has_word),
                       lambda line: F.struct(line_hash(line).alias("h"), F.size(F.split(trimmed(line), BLANK_RUN)).alias("n")))


def _repeat_words(df: DataFrame, out: str) -> DataFrame:
    """Words that lie in 3-word windows found twice or more. ``_q_words`` holds the words."""
    windows = F.transform(each(F.size("_q_words") - 2), lambda i: F.xxhash64(
        F.get(F.col("_q_words"), i), F.get(F.col("_q_words"), i + 1), F.get(F.col("_q_words"), i + 2)))
    df = df.withColumn("_q_windows", windows).drop("_q_words")
    df = df.withColumn("_q_repeats", F.size(F.array_distinct("_q_windows")) < F.size("_q_windows"))
    # sorted by hash, equal windows are neighbours; documents without a repeat skip the sort
    ranked = F.sort_array(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_q_sorted", F.when(F.col("_q_repeats"), ranked))
    same = lambda x, k: F.coalesce(F.get(F.col("_q_sorted"), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("_q_sorted"), k + 1)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("_q_sorted", same), lambda x: x["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                          lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"]
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_q_windows", "_q_repeats", "_q_sorted")


def base_measures(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, base counts and ``base_failed`` of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, body.alias("_q_text"))
    df = df.withColumns({
        "_q_words": words(F.col("_q_text")),
        "word_chars": F.length(F.translate("_q_text", BLANKS, "")).cast("long"),
        "n_symbols": (F.length("_q_text") - F.length(F.translate("_q_text", SYMBOLS, ""))).cast("long"),
        "_q_lines": F.filter(F.split("_q_text", "\n"), has_word),
    }).drop("_q_text")
    df = df.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
    }).drop("_q_lines")
    df = _repeat_words(df, "n_repeat_words")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))




def removals(lines: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """From rows (host, key, lines), one row for each (host, key) that loses lines: removed words and line hashes."""
    distinct = lines.groupBy("host", "key").agg(F.first("lines").alias("lines"))
    distinct = staged(distinct, "quality-lines")
    hashes = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    counts = distinct.select("host", F.explode(hashes).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"))
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    same_host = lambda a, b: a["host"].eqNullSafe(b["host"])
    often = counts.filter(F.col("docs") > min_docs)
    frequent = (often.join(hosts, same_host(often, hosts)).filter(F.col("docs") > F.col("host_docs") * max_share)
                .select(often["host"].alias("f_host"), F.col("h").alias("f_h")))
    frequent = staged(frequent, "quality-frequent")
    found = distinct.select("host", "key", F.explode("lines").alias("line")).select("host", "key", "line.h", "line.n")
    hit = found.join(frequent, found["host"].eqNullSafe(frequent["f_host"]) & (found["h"] == frequent["f_h"]), "left_semi")
    return hit.groupBy("host", "key").agg(F.sum("n").alias("removed_words"), F.collect_set("h").alias("removed"))


def _joined(left: DataFrame, lost: DataFrame) -> DataFrame:
    lost = lost.select(F.col("host").alias("_q_lost_host"), F.col("key").alias("_q_lost_key"), "removed_words", "removed")
    on = F.col("_q_host").eqNullSafe(F.col("_q_lost_host")) & (F.col("_q_key") == F.col("_q_lost_key"))
    return left.join(dealt(lost), on, "left").drop("_q_lost_host", "_q_lost_key")


def _kept() -> Column:
    left = F.col("n_words") - F.coalesce(F.col("removed_words"), F.lit(0))
    depleted = F.col("removed_words").isNotNull() & ((left < MIN_WORDS) | (left < MIN_LEFT * F.col("n_words")))
    return ~F.col("base_failed") & ~depleted


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """id, base counts, ``base_failed``, ``removed_words`` and ``kept`` for every row of ``docs``."""
    prepared = docs.select(F.col(id_col).alias("_q_id"), F.col(host).alias("_q_host"), F.col(text).alias("_q_body"),
                           content_key(F.col(text)).alias("_q_key"), line_table(F.coalesce(F.col(text), F.lit(""))).alias("_q_table"))
    narrow = staged(base_measures(prepared, "_q_body", ["_q_id", "_q_host", "_q_key", "_q_table"]), "quality-base")
    lost = removals(narrow.select(F.col("_q_host").alias("host"), F.col("_q_key").alias("key"), F.col("_q_table").alias("lines")))
    return (_joined(narrow.drop("_q_table"), lost).withColumn("kept", _kept())
            .select(F.col("_q_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), "kept"))


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The kept rows of ``docs``, all columns, with frequent lines taken out of their texts."""
    keyed = docs.withColumns({"_q_host": F.col(host), "_q_key": content_key(F.col(text))})
    prepared = keyed.select("_q_host", "_q_key", F.col(text).alias("_q_body"), line_table(F.coalesce(F.col(text), F.lit(""))).alias("_q_table"))
    narrow = staged(base_measures(prepared, "_q_body", ["_q_host", "_q_key", "_q_table"]), "quality-base")
    lost = staged(removals(narrow.select(F.col("_q_host").alias("host"), F.col("_q_key").alias("key"), F.col("_q_table").alias("lines"))), "quality-lost")
    # one verdict for each (host, text): rejected ones go by an anti join, so rejected texts do not move twice
    verdict = _joined(narrow.drop("_q_table").dropDuplicates(["_q_host", "_q_key"]), lost).withColumn("kept", _kept())
    good = staged(verdict.filter("kept").select(F.col("_q_host").alias("_q_good_host"), F.col("_q_key").alias("_q_good_key"), F.col("removed").alias("_q_removed")), "quality-kept")
    on = F.col("_q_host").eqNullSafe(F.col("_q_good_host")) & (F.col("_q_key") == F.col("_q_good_key"))
    kept_lines = F.filter(F.split(F.col(text), "\n"), lambda line: ~F.coalesce(F.array_contains("_q_removed", line_hash(line)), F.lit(False)) | ~has_word(line))
    return (keyed.join(dealt(good), on)
            .withColumn(text, F.when(F.col("_q_removed").isNull(), F.col(text)).otherwise(F.array_join(kept_lines, "\n")))
            .select(*docs.columns))
