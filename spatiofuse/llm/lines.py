"""Line dedup by winnowing over line hashes (native DataFrame operations only).

A unit is a line, or a sentence of a line (a text is also cut after ``. ``,
``! `` and ``? ``), so a passage is found where it starts inside a line. Units are
compared lower-cased and trimmed, by hash.

* A *gram* of a unit is the shortest run of units from it with ``gram_words``
  words or more. In every shortest run with ``run_words`` words or more, the gram
  with the least hash is selected (ties: the first). Two documents that share a
  run of ``run_words`` words therefore share a selected gram: the fingerprints
  are guaranteed.
* Occurrences of a fingerprint are joined with its first one, in the order of
  (doc_id, content key, position). Later ones are repeats of ``gram_words`` words
  at least; each is extended unit by unit both ways against the first, up to the
  next repeated fingerprint, which extends by itself.
* Units in later repeats are deleted; the first occurrence stays whole.

Defined results: a null text stays null, an empty one empty; texts under
``run_words`` words are never cut; rows that repeat both id and text are one
document and get the same result; a null id counts as the first of all; added
columns begin with ``_w_``; other columns are kept; an empty table stays empty.

Scale: two in five units give a row (16 bytes) to one shuffle that is combined on
the map side. Only repeated fingerprints are joined, always against one first
occurrence, so a passage in a third of all documents makes rows in proportion to
them and its key can be split. Work in a row is in proportion to the document.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiofuse.llm.staging import dealt, staged
from spatiofuse.llm.words import BLANK_RUN, content_key, each, has_word, trimmed

#: Production parameters: words from which a repeated run is surely found, and words of a gram.
RUN_WORDS, GRAM_WORDS = 50, 25

_MARK = "\x01"
_ENDS = (("\n", "\n"), (". ", ". "), ("! ", "! "), ("? ", "? "))


def units(text: Column) -> Column:
    """The text in pieces that join to it again; each holds a word (a text without words is one piece)."""
    marked = text
    for end, same in _ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(same + _MARK))
    marked = F.regexp_replace(marked, f"{_MARK}(?=[\\s{_MARK}]*$|\\s*{_MARK})", "")  # no piece of blanks alone
    blank_start = F.substring(text, 1, 1).isin([" ", "\t", "\n", "\x0b", "\f", "\r"])
    marked = F.when(blank_start, F.regexp_replace(marked, f"^(\\s*){_MARK}", "$1")).otherwise(marked)
    plain = F.split(marked, _MARK)
    # a text that holds the mark itself is cut by the slower equal rule
    exact = F.split(text, "(?<=\\n)(?=[\\s]*[^\\s])|(?<=[.!?]\\x20)(?=[\\s]*[^\\s])")
    return F.when(F.instr(text, _MARK) > 0, exact).otherwise(plain)


#: What makes words of a unit uncountable by its spaces.
_ODD_BLANKS = ("  ", "\t", "\x0b", "\x0c", "\r")


def _unit_words(inner: Column, even: Column) -> Column:
    """Words of a trimmed unit: its spaces and one where the text's blanks are ``even``, else by splitting."""
    spaces = F.octet_length(inner) - F.octet_length(F.replace(inner, F.lit(" "), F.lit("")))
    return F.when(even, spaces + 1).otherwise(F.size(F.split(inner, BLANK_RUN)))


def _get(name: str, i) -> Column:
    return F.get(F.col(name), i)


def fingerprinted(keyed: DataFrame, run_words: int, gram_words: int) -> DataFrame:
    """From (_w_id, _w_key, _w_text): unit hashes ``H``, gram ends and the selected (hash, unit, end) of every document."""
    df = keyed.withColumns({"_w_units": F.filter(F.transform(units(F.col("_w_text")), trimmed), lambda u: u != ""), "_w_even": ~reduce(or_, [F.contains("_w_text", F.lit(x)) for x in _ODD_BLANKS])}).drop("_w_text")
    df = df.withColumns({"H": F.transform("_w_units", lambda u: F.xxhash64(F.lower(u))),
                         "N": F.transform("_w_units", lambda u: _unit_words(u, F.col("_w_even")))}).drop("_w_units", "_w_even")
    # of every word its unit and whether it begins one, and of every unit its first word
    df = df.withColumns({"A": F.flatten(F.transform("N", lambda n, k: F.array_repeat(k, n))),
                         "B": F.flatten(F.transform("N", lambda n: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), n - 1))))}).drop("N")
    df = df.withColumn("S", F.concat(F.filter(each(F.size("B")), lambda c: _get("B", c)), F.array(F.size("B")))).drop("B")
    fits = F.col("S")  # units whose gram fits
    ends = F.transform(F.filter(fits, lambda s: s + gram_words <= F.size("A")), lambda s: _get("A", s + (gram_words - 1)))
    df = df.withColumn("E", ends)
    df = df.withColumn("G", F.transform("E", lambda e, k: F.struct(
        F.xxhash64(F.slice("H", k + 1, e - k + 1)).alias("h"), k.alias("p"))))
    last_gram = lambda s: _get("A", _get("S", _get("A", s + (run_words - 1)) + 1) - gram_words)
    chosen = F.transform(F.filter(F.col("S"), lambda s: s + run_words <= F.size("A")),
                         lambda s, k: F.array_min(F.slice("G", k + 1, last_gram(s) - k + 1))["p"])
    df = df.withColumn("_w_chosen", F.array_distinct(chosen)).drop("S", "A")
    return df.select("_w_id", "_w_key", "H", F.transform("_w_chosen", lambda p: F.struct(
        _get("G", p)["h"].alias("h"), p.alias("p"), _get("E", p).alias("e"))).alias("F"))


def _matching(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int")


def _part(array: Column, start: Column, length: Column) -> Column:
    """``length`` elements from 0-based ``start``; less at the end, none for length < 1."""
    return F.when(length < 1, F.array().cast("array<bigint>")).otherwise(F.slice(array, F.greatest(start, F.lit(0)) + 1, F.greatest(length, F.lit(0))))


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(_w_key, n, gone): for each document with a word its number of units, and the unit positions to delete (null: none)."""
    keyed = docs.select(F.col(id_col).alias("_w_id"), content_key(F.col(id_col), F.col(text)).alias("_w_key"), F.col(text).alias("_w_text"))
    marked = staged(fingerprinted(keyed.filter(has_word(F.col("_w_text"))), run_words, gram_words), "line-fingerprints")

    place = F.struct("_w_id", "_w_key", "p").alias("at")
    seen = marked.select("_w_id", "_w_key", F.explode("F").alias("f")).select("_w_id", "_w_key", "f.h", "f.p", "f.e")
    groups = seen.select("h", place).groupBy("h").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = staged(groups.filter("n > 1").select("h", F.col("first._w_id").alias("f_id"), F.col("first._w_key").alias("f_key"), F.col("first.p").alias("f_p")), "line-firsts")
    later = (seen.join(dealt(firsts), "h")
             .filter(~((F.col("_w_key") == F.col("f_key")) & (F.col("p") == F.col("f_p"))))
             .groupBy("_w_key").agg(F.sort_array(F.collect_set(F.struct("p", "e", "f_key", "f_p"))).alias("R")))
    later = staged(later, "line-later")

    # stretch on both sides of each repeat, up to its neighbours
    hashes = staged(marked.select("_w_key", "H").dropDuplicates(["_w_key"]), "line-hashes")  # staged, so that a hot first document can be split in the joins
    near = lambda i: F.get(F.col("R"), i)
    around = F.transform("R", lambda r, i: F.struct(
        r["p"].alias("p"), r["e"].alias("e"), r["f_key"].alias("f_key"), r["f_p"].alias("f_p"),
        (F.coalesce(near(i - 1)["e"], F.lit(-1)) + 1).alias("lo"),
        (F.coalesce(near(i + 1)["p"], F.size("H")) - 1).alias("hi")))
    wide = (later.join(dealt(hashes), "_w_key").select("_w_key", "H", F.explode(around).alias("r"))
            .select("_w_key", "r.*",
                    F.reverse(_part(F.col("H"), F.col("r.lo"), F.col("r.p") - F.col("r.lo"))).alias("before"),
                    _part(F.col("H"), F.col("r.e") + 1, F.col("r.hi") - F.col("r.e")).alias("after")))
    open_ended = (F.size("before") > 0) | (F.size("after") > 0)
    wide = staged(wide, "line-stretches")
    first_hashes = hashes.select(F.col("_w_key").alias("f_key"), F.col("H").alias("f_H"))
    f_e = F.col("f_p") + F.col("e") - F.col("p")
    grown = wide.filter(open_ended).join(dealt(first_hashes), "f_key").withColumns({
        "left": _matching(F.col("before"), F.reverse(_part(F.col("f_H"), F.col("f_p") - F.size("before"), F.least(F.size("before"), F.col("f_p"))))),
        "right": _matching(F.col("after"), _part(F.col("f_H"), f_e + 1, F.size("after")))})
    columns = ["_w_key", "f_key", "p", "e", "f_p", "left", "right"]
    spans = grown.select(columns).unionByName(wide.filter(~open_ended).withColumns({"left": F.lit(0), "right": F.lit(0)}).select(columns))
    own = F.col("_w_key") == F.col("f_key")  # a repeat of the same document must not delete its first occurrence
    start = F.col("p") - F.col("left")
    start = F.when(own, F.greatest(start, F.col("f_p") + F.col("e") - F.col("p") + 1)).otherwise(start)
    spans = spans.withColumns({"start": start, "stop": F.col("e") + F.col("right")}).filter("start <= stop")
    gone = spans.groupBy("_w_key").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", "stop")))).alias("gone"))
    return hashes.select("_w_key", F.size("H").alias("n")).join(dealt(gone), "_w_key", "left")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """``docs`` with later repeated runs cut from ``text``, and ``_w_units``, ``_w_gone``: units before, units deleted."""
    gone = staged(repeats(docs, id_col, text, run_words, gram_words), "line-gone")
    gone = gone.select(F.col("_w_key").alias("_w_gone_key"), F.col("n").alias("_w_n"), F.col("gone").alias("_w_list"))
    joined = docs.withColumn("_w_key", content_key(F.col(id_col), F.col(text))).join(dealt(gone), F.col("_w_key") == F.col("_w_gone_key"), "left")
    joined = joined.withColumn("_w_parts", F.when(F.col("_w_list").isNotNull(), units(F.col(text))))  # few texts are cut again
    left = F.array_except(each(F.size("_w_parts")), F.col("_w_list"))
    cut = F.array_join(F.transform(left, lambda i: _get("_w_parts", i)), "")
    return (joined.withColumns({text: F.when(F.col("_w_list").isNull(), F.col(text)).otherwise(cut),
                                "_w_units": F.coalesce("_w_n", F.lit(0)),
                                "_w_gone": F.coalesce(F.size("_w_list"), F.lit(0))})
            .drop("_w_key", "_w_gone_key", "_w_n", "_w_list", "_w_parts"))
