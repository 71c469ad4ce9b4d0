"""Best-fit packing of token sequences by bin completion.

Documents are tokenised, closed by an end id and cut only where longer than a
sequence. Pieces of one length are interchangeable, so the plan is made from the
histogram of lengths (at most ``capacity`` numbers, whatever the corpus): the
largest remaining piece is completed by the undominated filling that wastes least,
as often as the counts allow; fillings are found by branch and bound on the space
they leave, with the best-fit filling as incumbent. The last pieces are packed by an
exact search that backtracks over fillings and stops at the bound
ceil(total / bins). Best-fit decreasing over the histogram is the incumbent for the
whole: the plan is never worse.

Pieces then take their places by their rank among the pieces of their length, from
counts per (length, salt): the ranks are dense and no task ranks a whole length.

Defined results: null and empty texts are a piece with the end id alone; repeated
rows, and null ids, are packed as rows of their own; other columns play no part; an
empty table gives an empty table.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatiofuse.llm.staging import dealt, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY, END_ID = 4096, 1
#: ASCII marks that the tokenizer parts from letters, whatever stands beside them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words kept in a worker's cache; beyond, it starts anew.
CACHED_WORDS = 400_000
#: Ranks of one length are counted apart in so many salts.
SALTS = 1024
#: Nodes that the search for one filling, and for the last pieces, may visit.
FILLING_NODES, TAIL_NODES, TAIL_PIECES = 3_000, 20_000, 48


class WordIds(dict):
    """Word to its ids as little-endian 32-bit bytes; equal to encoding the text whole.

    Valid for tokenizers that drop white space: no token reaches over a blank.
    Runs of Latin-1 letters skip the normaliser, for which they are lower-cased
    alone, and ASCII marks on either side of them are runs of their own, so that
    a word shares its ids with its other cases and marks. Anything else, and all
    words with an apostrophe or an added token, go through ``encode``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.letters = [chr(b) if b in printable else chr(next(rest)) for b in range(256)]  # byte-level alphabet

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        core = word.strip(MARKS)
        if core.isalpha() and max(core) < "Ā" and (len(core) == len(word) or not any(x in word for x in self.added)):
            low = core.lower()
            if low != word:
                left, right = word[:word.index(core)], word[len(word.rstrip(MARKS)):]
                made = (self[left] if left else b"") + self[low] + (self[right] if right else b"")
            else:
                if not low.isascii():
                    low = "".join([self.letters[b] for b in low.encode()])
                made = np.array([t.id for t in self.merge(low)], "<u4").tobytes()
        else:
            made = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = made
        return made

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


def word_ids(path: str) -> WordIds:
    """One cache per worker process and tokenizer."""
    held = sys.__dict__.setdefault("_word_ids", {})
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every row; ids are little-endian unsigned 32-bit."""
    def run(batches):
        encoder, end, step = word_ids(tokenizer), int(end_id).to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            ids, rows = batch.column(0), []
            for k, value in enumerate(batch.column(1)):
                line = encoder.encode(value.as_py() or "") + end
                rows += [(k, at // step, at // 4, line[at:at + step]) for at in range(0, len(line), step)]
            arrays = [ids.take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
                      pa.array([len(r[3]) // 4 for r in rows], pa.int64()), pa.array([zlib.crc32(r[3]) for r in rows], pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array([r[3] for r in rows], pa.binary())], [*names, "ids"]
            yield pa.record_batch(arrays, names=names)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (lengths of a bin, number of such bins)."""
    open_bins: dict[int, dict[tuple, int]] = {}  # space left -> fillings and how many
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            space = min((s for s in open_bins if s >= length), default=None)
            if space is None:
                fit = capacity // length
                full, rest = divmod(left, fit)
                for n, many in ((fit, full), (rest, 1)):
                    if n and many:
                        bins = open_bins.setdefault(capacity - n * length, {})
                        bins[(length,) * n] = bins.get((length,) * n, 0) + many
                break
            bins = open_bins[space]
            filling, many = next(iter(bins.items()))
            fit = space // length
            used = min(many, max(1, left // fit))
            n = min(fit, left)
            used = min(used, left // n)
            bins[filling] -= used
            if not bins[filling]:
                del bins[filling]
                if not bins:
                    del open_bins[space]
            new = filling + (length,) * n
            target = open_bins.setdefault(space - n * length, {})
            target[new] = target.get(new, 0) + used
            left -= used * n
    return [x for bins in open_bins.values() for x in bins.items()]


def fillings(lengths: list[int], counts: dict[int, int], space: int, slack: int, nodes: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``space``, least waste first, none wasting more than ``slack`` unless it is the best.

    ``lengths`` ascends. A filling is dominated if a piece left out still fits, or fits in place of a smaller one.
    The best-fit filling comes first and bounds the search.
    """
    best, waste, found, visited = (), space, {}, 0

    def closed(chosen, left):
        """No piece left out fits."""
        used = dict(chosen)
        for x in lengths:
            if x > left:
                return True
            if counts[x] > used.get(x, 0):
                return False
        return True

    def walk(at, left, chosen):
        """``chosen``: (length, times), longest first. Classes are taken as often as they fit, then less."""
        nonlocal best, waste, visited
        visited += 1
        at = min(at, bisect_right(lengths, left) - 1)
        if (left <= slack or left < waste) and closed(chosen, left):
            filling = tuple(x for x, n in chosen for _ in range(n))
            found[filling] = left
            if left < waste or not best:
                best, waste = filling, min(left, waste)
        for k in range(at, -1, -1):
            for n in range(min(counts[lengths[k]], left // lengths[k]), 0, -1):
                if visited > nodes or waste == 0:
                    return
                walk(k - 1, left - n * lengths[k], (*chosen, (lengths[k], n)))

    walk(len(lengths) - 1, space, ())
    if not found:
        found[best] = waste
    return [f for f, left in sorted(found.items(), key=lambda x: (x[1], tuple(-y for y in x[0]))) if left <= max(slack, waste)]


def _exact(counts: dict[int, int], capacity: int, limit: int) -> list[tuple[int, ...]] | None:
    """Fewest bins, if fewer than ``limit``; None if the search finds no better in its nodes."""
    total, best, visited = sum(x * n for x, n in counts.items()), None, 0

    def solve(counts, left, bins):
        nonlocal best, limit, visited
        if not left:
            if len(bins) < limit:
                best, limit = bins, len(bins)
            return
        visited += 1
        slack = (limit - 1) * capacity - total - sum(capacity - sum(b) for b in bins)  # waste that may still be added
        if visited > TAIL_NODES or slack < 0 or len(bins) + -(-left // capacity) >= limit:
            return
        first = max(counts)
        rest = {x: n - (x == first) for x, n in counts.items() if n > (x == first)}
        for filling in fillings(sorted(rest), rest, capacity - first, min(slack, capacity), FILLING_NODES):
            after = dict(rest)
            for x in filling:
                after[x] -= 1
            solve({x: n for x, n in after.items() if n}, left - first - sum(filling), [*bins, (first, *filling)])
            if limit <= -(-total // capacity) or visited > TAIL_NODES:
                return

    solve(dict(counts), total, [])
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, number of such bins) for all pieces, by bin completion."""
    counts = {x: n for x, n in histogram.items() if n}
    incumbent = best_fit(counts, capacity)
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    if sum(n for _, n in incumbent) == bound:
        return incumbent
    bins, left = [], dict(counts)
    while sum(left.values()) > TAIL_PIECES:
        first = max(left)
        left[first] -= 1
        usable = sorted(x for x, n in left.items() if n and x <= capacity - first)
        filling = fillings(usable, left, capacity - first, 0, FILLING_NODES)[0]
        left[first] += 1
        whole = (first, *filling)
        times = min(left[x] // whole.count(x) for x in set(whole))
        for x in set(whole):
            left[x] -= times * whole.count(x)
        left = {x: n for x, n in left.items() if n}
        bins.append((whole, times))
    if left:
        tail = best_fit(left, capacity)
        better = _exact(left, capacity, sum(n for _, n in tail))
        bins += [(b, 1) for b in better] if better else tail
    return min(bins, incumbent, key=lambda p: sum(n for _, n in p))


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): which ranks go to which bins, and where in them."""
    rows, used, sequence = [], {}, 0
    for whole, times in patterns:
        offset = 0
        for length in sorted(set(whole), reverse=True):
            n = whole.count(length)
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "n", "sequence", "offset"))}


def packed(table: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``table`` (staged; column length between 1 and ``capacity``) with sequence_id and offset."""
    salted = table.withColumn("_p_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    sizes = staged(salted.groupBy("length", "_p_salt").agg(F.count(F.lit(1)).alias("_p_n")), "packing-sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_p_n").alias("n")).collect()}  # at most ``capacity`` rows
    where = placements(plan(histogram, capacity))
    before = W.partitionBy("length").orderBy("_p_salt").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("length", "_p_salt", F.coalesce(F.sum("_p_n").over(before), F.lit(0)).alias("_p_base"))
    ranked = (salted.withColumn("_p_rank", F.row_number().over(W.partitionBy("length", "_p_salt").orderBy(*order)) - 1)
              .join(dealt(bases), ["length", "_p_salt"]).withColumn("_p_rank", F.col("_p_rank") + F.col("_p_base")))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        first = np.searchsorted(where["length"], np.arange(capacity + 2))  # rows of each length
        out = np.empty((len(length), 2), np.int64)
        size, at = length.to_numpy(), rank.to_numpy()
        for x in np.unique(size):
            these = np.flatnonzero(size == x)
            lo, hi = first[x], first[x + 1]
            row = lo + np.searchsorted(where["rank"][lo:hi], at[these], "right") - 1
            step, n = at[these] - where["rank"][row], where["n"][row]
            out[these, 0] = where["sequence"][row] + step // n
            out[these, 1] = where["offset"][row] + step % n * x
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    return (ranked.withColumn("_p_place", place("length", "_p_rank"))
            .select(*table.columns, "_p_place.sequence_id", "_p_place.offset"))


def packed_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of every document with their sequence and place."""
    table = staged(pieces(docs, tokenizer, id_col, text, capacity, with_ids=with_ids), "packing-pieces")
    return packed(table, ["id", "piece", "ids_crc32"], capacity)
