"""Mixing sources to target weights by pivotal dependent rounding (native DataFrame operations only).

Sources share a budget by weight; no target exceeds ``most`` times its source's size, and what
stops there is shared again among the rest. Every document of a source is expected target / size
times: the whole part is taken surely, and the fraction is rounded dependently.

Two documents with fractional probabilities are paired, and mass (words times probability) moves from
one to the other until one is taken or left. The direction is drawn so that both keep their
expectation, and the sum of their words stays exactly as it was. One document of a pair remains fractional and
meets the next. This goes on inside groups of about ``fan`` documents of a source and size class, whose
residuals are grouped again: a tree of a few levels. When ``reserve`` or fewer remain in each size class, one last group a
source takes them from the longest to the shortest, so that what finally remains is as a rule short; it is rounded to the
nearest. A source's words therefore miss its target by half of that one document.

Defined results: a null or empty text has size 0 and is taken as often as its whole part says; rows that repeat id, source and text are one
document held n times, and their copies are dealt evenly; a null source comes last; a null id is an id; very long texts
are counted whole; ties of the draw's order go by id and text; the draws depend on ids, texts and seed alone, so reruns agree; other columns play
no part; an empty table gives an empty table.

Scale: one shuffle of narrow rows with copies combined before it, one of about 40 bytes a document for the first level, and less by
``fan`` for each further level. A source with a third of all rows has as many groups as it needs. Targets need totals
of each source; their order comes from range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiofuse.llm.ranks import placed
from spatiofuse.llm.staging import staged
from spatiofuse.llm.words import content_key

#: Production parameters: weights by place of the source, share of all sizes in percent, most copies, seed.
WEIGHTS, PERCENT, MOST, SEED = (3, 1, 2), 150, 2, 2024
#: Documents of a group of the reduction tree, and documents of a size class that wait for the last group.
FAN, RESERVE = 64, 32
#: Rows that one array lists at a time.
_RUN = 100_000


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    order = [F.col("source").asc_nulls_last()]  # strings sort by code point
    rows = placed(sizes, order, "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = staged(rows.select("source", "source_size", weight.cast("double").alias("weight")), "mix-sources")
    cap = F.col("source_size") * F.lit(float(most))
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    share, held = None, -1
    while True:  # sources over their limit at this share stop there; each turn adds some or is the last
        stopped = F.lit(False) if share is None else F.lit(share) * F.col("weight") > cap
        n, mass, free = rows.agg(F.count(F.when(stopped, 1)), F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0))).first()
        if n == held or not free:
            break
        share, held = (budget - mass) / free, n
    return rows.select("source", "source_size", F.least(F.lit(share or 0.0) * F.col("weight"), cap).alias("target"))


def _chance(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _step(level: int, seed: int):
    """Fold of a group: (open: the fractional document or null, done: rounded ones)."""
    def move(held: Column, new: Column) -> Column:
        a, b = held["open"], new
        up = F.least(a["size"] - a["mass"], b["mass"])        # what a can take from b
        down = F.least(a["mass"], b["size"] - b["mass"])      # what b can take from a
        rise = _chance(F.lit(seed), F.lit(level), a["key"], b["key"]) * (up + down) < down
        fills = a["size"] - a["mass"] <= b["mass"]            # rising, a is full before b is empty
        empties = a["mass"] <= b["size"] - b["mass"]          # falling, a is empty before b is full

        def state(x: Column, mass: Column) -> Column:
            return F.struct(x["key"].alias("key"), x["size"].alias("size"), mass.cast("double").alias("mass"))

        def result(open_: Column, closed: Column, taken: Column) -> Column:
            return F.struct(open_.alias("open"), F.concat(held["done"], F.array(F.struct(closed["key"].alias("key"), taken.alias("extra")))).alias("done"))

        one, none = F.lit(1), F.lit(0)
        moved = (F.when(rise & fills, result(state(b, b["mass"] - up), a, one))
                 .when(rise, result(state(a, a["mass"] + up), b, none))
                 .when(empties, result(state(b, b["mass"] + down), a, none))
                 .otherwise(result(state(a, a["mass"] - down), b, one)))
        first = F.struct(state(b, b["mass"]).alias("open"), held["done"].alias("done"))
        return F.when(a.isNull(), first).otherwise(moved)
    return move


def _folded(rows: DataFrame, groups: list[str], level: int, seed: int) -> DataFrame:
    """Per group, its fractional document ``open`` and its rounded ones ``done``; documents meet from the longest to the shortest."""
    member = F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(seed), F.lit(level), "key").alias("draw"), "key", "size", "mass")
    start = F.struct(F.lit(None).cast("struct<key:binary,size:bigint,mass:double>").alias("open"), F.array().cast("array<struct<key:binary,extra:int>>").alias("done"))
    folded = F.aggregate("members", start, _step(level, seed))
    return rows.groupBy(*groups).agg(F.sort_array(F.collect_list(member)).alias("members")).select(*groups, folded.alias("f")).select(*groups, "f.open", "f.done")


def rounded(parts: DataFrame, fan: int = FAN, reserve: int = RESERVE, seed: int = SEED) -> DataFrame:
    """(key, extra): each document of (source, key, size, mass), 0 < mass < size, taken once more (1) or not (0)."""
    size_class = F.length(F.bin("size"))
    left = staged(parts.select("source", "key", "size", "mass", size_class.alias("class")), "mix-parts")
    done, level = [], 0
    while True:
        counts = left.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 0) <= fan:
            break
        crowded = staged(counts.filter(F.col("n") > fan).select("source", "class", F.greatest(F.lit(reserve), F.ceil(F.col("n") / fan)).alias("groups")), "mix-groups")
        match = left["source"].eqNullSafe(crowded["source"]) & (left["class"] == crowded["class"])
        many = left.join(crowded, match).select(left["*"], F.pmod(F.xxhash64(F.lit(seed), F.lit(-1 - level), left["key"]), F.col("groups")).alias("group"))
        few = left.join(crowded, match, "left_anti")
        folded = staged(_folded(many, ["source", "class", "group"], level, seed), f"mix-level{level}")
        done.append(folded)
        left = staged(few.unionByName(folded.filter("open is not null").select("source", "open.key", "open.size", "open.mass", "class")), f"mix-left{level}")
        level += 1
    last = staged(_folded(left, ["source"], level, seed), "mix-last")
    end = last.filter("open is not null").select("open.key", F.when(2 * F.col("open.mass") >= F.col("open.size"), 1).otherwise(0).alias("extra"))
    out = end
    for part in [*done, last]:
        out = out.unionByName(part.select(F.explode("done").alias("d")).select("d.key", "d.extra"))
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, percent: int = PERCENT,
          most: int = MOST, fan: int = FAN, reserve: int = RESERVE, seed: int = SEED) -> DataFrame:
    """(key, id, source, size, n, source_size, target, copies): every distinct document, the rows that hold it, and how often the mix takes it."""
    rows = docs.select(content_key(F.col(id_col), F.col(source), F.col(text)).alias("key"), F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    items = staged(rows.groupBy("key", "id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-items")
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = staged(targets(sizes, weights, percent, most).withColumnRenamed("source", "m_source"), "mix-targets")
    aimed = items.join(aims, items["source"].eqNullSafe(F.col("m_source"))).drop("m_source")
    expected = F.when(F.col("source_size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = aimed.withColumn("expected", expected).withColumn("sure", F.floor("expected").cast("long"))
    aimed = staged(aimed.withColumn("mass", F.col("size") * (F.col("expected") - F.col("sure"))).drop("expected"), "mix-aimed")
    open_ = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    more = staged(rounded(aimed.filter(open_), fan, reserve, seed), "mix-rounded").select(F.col("key").alias("m_key"), "extra")
    copies = F.col("sure") + F.coalesce("extra", F.lit(0))
    return (aimed.join(more, F.col("key") == F.col("m_key"), "left")
            .select("key", "id", "source", "size", "n", "source_size", "target", copies.cast("long").alias("copies")))


def by_row(mix: DataFrame) -> DataFrame:
    """A row for each row of the input: the copies of a document are dealt evenly to the rows that hold it."""
    low, high = F.expr("copies div n"), F.col("copies") % F.col("n")
    runs = lambda n, copies: F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(n / _RUN) - 1), lambda i: F.struct(
        F.least(F.lit(_RUN).cast("long"), n - i * _RUN).alias("rows"), copies.alias("copies")))
    none = F.array().cast("array<struct<rows:bigint,copies:bigint>>")
    some = lambda n, copies: F.when(n > 0, runs(n, copies)).otherwise(none)
    split = mix.withColumn("m_run", F.explode(F.concat(some(high, low + 1), some(F.col("n") - high, low))))
    return (split.withColumn("m_row", F.explode(F.array_repeat(F.lit(True), F.col("m_run.rows").cast("int"))))
            .select("id", "source", "size", "source_size", "target", F.col("m_run.copies").alias("copies")))


def mixture(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: one row of each distinct document that is taken, all columns, with ``copies``."""
    taken = mixed(docs, id_col, text, source, **options).filter("copies > 0").select(F.col("key").alias("m_key"), "copies")
    keyed = docs.withColumn("m_own", content_key(F.col(id_col), F.col(source), F.col(text))).dropDuplicates(["m_own"])
    return keyed.join(taken, F.col("m_own") == F.col("m_key")).select(*docs.columns, "copies")
