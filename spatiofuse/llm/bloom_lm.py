"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels, level = 1 + floor(log2 c),
and the filter holds (n-gram, j) for every j up to the n-gram's level. A count is read
back by probing j = 1, 2, ... until the first miss: a filter never understates a
level, and overstates one with a chance of about 1 %. Pairs are held from a count of
two; the chance ``mix`` that the next pair is such a pair is taken from the counts.

score = sum over tokens of log10(mix * c(prev, w) / c(prev) + (1 - mix) * p(w)), where
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), with c from the filter. The base score is the
same sum of log10 p(w) with exact counts.

A token is a word of the text with A-Z lower-cased, or the one end of each text. Words
are told apart by a 64-bit hash.

Scale. Counting shuffles one row per distinct n-gram and task. The filter grows with
the corpus: blocks of 128 KB, filled by the tasks, in segments of at most
``SEGMENT_BLOCKS`` blocks (64 MB). One segment at a time is collected and broadcast,
and a pass over the texts reads the levels of the n-grams that belong to it; a corpus
with S segments takes S passes and never a larger broadcast. Exact counts of the at most
``HEAVY`` words with N / HEAVY or more occurrences are broadcast (16 MB at most, as
counts add up to N); all other words are joined.

Defined results: null and empty texts hold the end alone; a null id is not held out;
repeated rows are counted and scored each; without training rows N = V = 0 and every
token has probability 1 in the base and the model; other columns play no part; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiofuse.llm.staging import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE, MIN_PAIR = 2.0, 2
HEAVY = 1 << 20
#: Bits of a block, n-gram levels meant for one, probes of each, and blocks of a segment.
BLOCK_BITS, BLOCK_LEVELS, PROBES, SEGMENT_BLOCKS = 1 << 20, 100_000, 6, 512
#: Tokens that a task counts before it hands on.
CHUNK = 2_000_000
END, START = b"\n", np.uint64(0x9E3779B97F4A7C15)
MAX_LEVEL = 1 + int(math.log(2 ** 62) / math.log(BASE))
CACHED_WORDS = 200_000

_K1, _K2, _K3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


class Hashes(dict):
    """Word to its 64-bit hash, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


def words_of(text: str | None) -> list[bytes]:
    """Tokens of a text, its end last; bytes lower-case A-Z and split at ASCII blanks only."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    parts.append(END)
    return parts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def token_arrays(texts: list, cache: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, hashes of (previous, word), and where each text begins, with the total last."""
    lists = [words_of(t) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    look = cache.__getitem__
    ids = np.fromiter((look(w) for x in lists for w in x), np.uint64, int(bounds[-1]))
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = START
    return ids, _mixed(before * _K3 + ids), bounds


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE count), exact at the edges."""
    edges = np.array([BASE ** k for k in range(MAX_LEVEL)])
    return np.searchsorted(edges, counts, "right").astype(np.int64)


def counts_of(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level (whole counts between its edges); 0 for level 0."""
    k = np.arange(MAX_LEVEL + 1)
    low = np.ceil(BASE ** (k - 1.0))
    high = np.maximum(low, np.ceil(BASE ** k.astype(float)) - 1)
    return np.where(k == 0, 0.0, np.sqrt(low * high))[levels]


def _halves(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First bit place and step of the places of each (hash, level) in a block."""
    h = _mixed(hashes + np.uint64((level * 2 + 1) * int(_K3) % (1 << 64))).view(np.int64)
    return h & (BLOCK_BITS - 1), ((h >> 32) & 0x7FFFFFFF) | 1


def _place(first: np.ndarray, step: np.ndarray, n: int) -> np.ndarray:
    return (first + n * step) & (BLOCK_BITS - 1)


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (_mixed(hashes ^ _K2) % np.uint64(blocks)).astype(np.int64)


def filled(hashes: np.ndarray, levels: np.ndarray) -> bytes:
    """A block's bytes with every (hash, j <= level) in it."""
    bits = np.zeros(BLOCK_BITS, bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        first, step = _halves(hashes[levels >= j], j)
        for n in range(PROBES):
            bits[_place(first, step, n)] = True
    return np.packbits(bits).tobytes()


def probed(segment: np.ndarray, first_block: int, blocks: int, hashes: np.ndarray) -> np.ndarray:
    """Levels that the segment (block, byte) shows for ``hashes``; 0 where another segment would."""
    block = block_of(hashes, blocks) - first_block
    levels = np.zeros(len(hashes), np.uint8)
    alive = np.flatnonzero((block >= 0) & (block < len(segment)))
    base, flat = block * (BLOCK_BITS // 8), segment.ravel()
    for j in range(1, MAX_LEVEL + 1):
        first, step = _halves(hashes[alive], j)
        for n in range(PROBES):  # most that are not there fall at the first places
            spot = _place(first, step, n)
            hit = (flat[base[alive] + (spot >> 3)] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1
            alive, first, step = alive[hit], first[hit], step[hit]
            if not len(alive):
                return levels
        levels[alive] = j
    return levels


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(n, h, c): words (n = 1) and pairs (n = 2) of the column ``t`` with their counts."""
    def run(batches):
        cache, words, pairs, held = Hashes(), {}, [], 0

        def out():
            ids, c1 = np.fromiter(words.keys(), np.uint64, len(words)), np.fromiter(words.values(), np.int64, len(words))
            two, c2 = np.unique(np.concatenate(pairs), return_counts=True)
            n = np.concatenate([np.ones(len(ids), np.int8), np.full(len(two), 2, np.int8)])
            return pa.record_batch([pa.array(n), pa.array(np.concatenate([ids, two]).view(np.int64)), pa.array(np.concatenate([c1, c2]))], names=["n", "h", "c"])

        for batch in (part for whole in batches for part in _parts(whole, 0)):
            ids, two, _ = token_arrays(batch.column(0).to_pylist(), cache)
            one, c = np.unique(ids, return_counts=True)
            for h, k in zip(one.tolist(), c.tolist()):
                words[h] = words.get(h, 0) + k
            pairs.append(two)
            held += len(ids)
            if held > CHUNK:
                yield out()
                words, pairs, held = {}, [], 0
        if held:
            yield out()
    rows = texts.mapInArrow(run, "n tinyint, h bigint, c bigint")
    return rows.groupBy("n", "h").agg(F.sum("c").alias("c"))


class Model:
    """Counts of a corpus: staged word counts, numbers, and the staged filter blocks."""

    def __init__(self, training: DataFrame, text: str = "text"):
        counts = ngram_counts(training.select(F.col(text).alias("t")))
        held = staged(counts.filter((F.col("n") == 1) | (F.col("c") >= MIN_PAIR)), "lm-counts")
        words = F.col("n") == 1
        level = F.least(F.lit(MAX_LEVEL), F.floor(F.log(F.col("c").cast("double")) / math.log(BASE)) + 2)
        sums = held.agg(F.sum(F.when(words, F.col("c"))), F.count(F.when(words, 1)), F.sum(F.when(~words, F.col("c"))), F.sum(level)).first()
        self.tokens, self.distinct, paired, entries = (int(x or 0) for x in sums)
        self.mix = paired / self.tokens if self.tokens else 0.0
        self.blocks = max(1, -(-entries // BLOCK_LEVELS))
        self.words = held.filter(words).select("h", "c")
        self.filter = staged(self._filter_blocks(held.select("h", "c")), "lm-filter")
        self.text_count = training.count()

    def _filter_blocks(self, held: DataFrame) -> DataFrame:
        blocks = self.blocks

        def numbered(batches):
            for batch in batches:
                h = batch.column(0).to_numpy().view(np.uint64)
                yield pa.record_batch([pa.array(block_of(h, blocks)), batch.column(0), pa.array(levels_of(batch.column(1).to_numpy()).astype(np.int16))], names=["block", "h", "level"])

        def built(batches):
            block, hashes, levels = None, [], []
            def out():
                return pa.record_batch([pa.array([block], pa.int64()), pa.array([filled(np.concatenate(hashes).view(np.uint64), np.concatenate(levels))], pa.binary())], names=["block", "bits"])
            for batch in batches:
                b, h, q = (batch.column(i).to_numpy() for i in range(3))
                for at in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1):
                    if not len(at):
                        continue
                    if b[at[0]] != block:
                        if block is not None:
                            yield out()
                        block, hashes, levels = int(b[at[0]]), [], []
                    hashes.append(h[at])
                    levels.append(q[at])
            if block is not None:
                yield out()

        rows = held.mapInArrow(numbered, "block bigint, h bigint, level smallint")
        return rows.repartition("block").sortWithinPartitions("block").mapInArrow(built, "block bigint, bits binary")

    def segments(self):
        """(first block, blocks by byte) of each segment, at most 64 MB."""
        for first in range(0, self.blocks, SEGMENT_BLOCKS):
            last = min(first + SEGMENT_BLOCKS, self.blocks)
            table = np.zeros((last - first, BLOCK_BITS // 8), np.uint8)
            for r in self.filter.filter((F.col("block") >= first) & (F.col("block") < last)).collect():
                table[r["block"] - first] = np.frombuffer(r["bits"], np.uint8)
            yield first, table

    def smoothed(self, c):
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def _parts(batch: pa.RecordBatch, column: int, most: int = 1_000_000):
    """Slices of a batch that hold ``most`` characters or one text."""
    start, size = 0, 0
    for i, n in enumerate(pc.coalesce(pc.utf8_length(batch.column(column)), 0).to_pylist()):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _levels(segment, first: int, blocks: int, one: np.ndarray, back: np.ndarray, pairs: np.ndarray, before: list) -> list[np.ndarray]:
    """Levels of words and pairs of some texts: what this segment knows and earlier ones have found."""
    out = []
    for levels, old in ((probed(segment, first, blocks, one)[back], before[0]), (probed(segment, first, blocks, pairs), before[1])):
        held = b"".join(x or b"" for x in old)
        out.append(levels | np.frombuffer(held, np.uint8) if held else levels)
    return out


def _levels_pass(df: DataFrame, first: int, shared, blocks: int) -> DataFrame:
    """Adds what one segment knows to the level bytes ``u`` (words) and ``b`` (pairs) of every text ``t``."""
    at = {c: i for i, c in enumerate(df.columns)}

    def run(batches):
        cache = Hashes()
        for whole in batches:
            for batch in _parts(whole, at["t"]):
                ids, pairs, bounds = token_arrays(batch.column(at["t"]).to_pylist(), cache)
                one, back = np.unique(ids, return_inverse=True)
                arrays = batch.columns
                found = _levels(shared.value, first, blocks, one, back, pairs, [batch.column(at[c]).to_pylist() for c in "ub"])
                for name, levels in zip("ub", found):
                    arrays[at[name]] = pa.array([levels[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.record_batch(arrays, names=df_columns)

    df_columns = df.columns
    return df.mapInArrow(run, df.schema)


def _score_pass(df: DataFrame, model: Model, heavy, first: int, shared) -> DataFrame:
    """The last segment's pass: the model's score, and the exact counts' share of heavy words; other words stay listed in ``light``."""
    at = {c: i for i, c in enumerate(df.columns)}
    table, norm = counts_of(np.arange(MAX_LEVEL + 1)), model.tokens + 0.5 * (model.distinct + 1)
    mix, starts, blocks = model.mix, model.text_count, model.blocks

    def run(batches):
        cache = Hashes()
        known, logs = heavy.value
        for whole in batches:
            for batch in _parts(whole, at["t"]):
                ids, pairs, bounds = token_arrays(batch.column(at["t"]).to_pylist(), cache)
                one, back = np.unique(ids, return_inverse=True)
                u, b = _levels(shared.value, first, blocks, one, back, pairs, [batch.column(at[c]).to_pylist() for c in "ub"])
                place = np.minimum(np.searchsorted(known, one), max(0, len(known) - 1))
                hit = known[place] == one if len(known) else np.zeros(len(one), bool)
                value = (np.where(hit, logs[place], 0.0) if len(known) else np.zeros(len(one)))[back]
                hit = hit[back]
                c, pair = table[u], table[b]
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[bounds[:-1]] = starts
                seen = np.where((pair > 0) & (before > 0), np.minimum(1.0, pair / np.maximum(before, 1)), 0.0)
                score = np.log10(mix * seen + (1 - mix) * (c + 0.5) / norm)
                rows = bounds[:-1]
                light_h, light_n, sizes = [], [], [0]
                for s, e in zip(bounds[:-1], bounds[1:]):
                    h, n = np.unique(ids[s:e][~hit[s:e]], return_counts=True)
                    light_h.append(h.view(np.int64))
                    light_n.append(n)
                    sizes.append(len(h))
                rare = pa.StructArray.from_arrays([pa.array(np.concatenate(light_h), pa.int64()), pa.array(np.concatenate(light_n), pa.int64())], names=["h", "n"])
                yield pa.record_batch([batch.column(at["id"]), batch.column(at["held_out"]), pa.array(np.diff(bounds), pa.int64()), pa.array(np.add.reduceat(hit.astype(np.int64), rows)),
                                       pa.array(np.add.reduceat(value, rows)), pa.array(np.add.reduceat(score, rows)), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), rare)],
                                      names=["id", "held_out", "n_tokens", "known", "part", "score", "light"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, known bigint, part double, score double, light array<struct<h:bigint,n:bigint>>")


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from rows that are not held out."""
    context = docs.sparkSession.sparkContext
    out = F.coalesce(held_out, F.lit(False))
    model = Model(docs.filter(~out), text)

    state = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), F.col(text).alias("t"), F.lit(None).cast("binary").alias("u"), F.lit(None).cast("binary").alias("b"))
    least = max(1, -(-model.tokens // HEAVY))  # at most HEAVY words can have as many
    often = model.words.filter(F.col("c") >= least).toPandas()
    keys, counts = often["h"].to_numpy(np.int64).view(np.uint64), often["c"].to_numpy(np.float64)
    order = np.argsort(keys)
    heavy = context.broadcast((keys[order], model.smoothed(counts[order])))
    # rows are numbered once; the numbers hold because they are written
    for first, table in model.segments():
        shared = context.broadcast(table)
        if first + SEGMENT_BLOCKS < model.blocks:
            state = staged(_levels_pass(state, first, shared, model.blocks), "lm-levels")
    exact = staged(_score_pass(state, model, heavy, first, shared).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    light = exact.select("row", F.explode("light").alias("x")).select("row", "x.h", "x.n")
    rest = model.words.filter(F.col("c") < least)
    norm = model.tokens + 0.5 * (model.distinct + 1)
    c = F.coalesce("c", F.lit(0))
    light = (light.join(rest, "h", "left").groupBy("row")
             .agg(F.sum(F.col("n") * F.log10((c + 0.5) / norm)).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known")))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return (exact.drop("light").join(light, "row", "left")
            .select("id", "held_out", "n_tokens", (F.col("known") + zero("more_known")).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
                    (F.col("part") + zero("more")).alias("base_score"), "score"))
