"""Ranked lexical search by the Best Position Algorithm over blocks of an impact-ordered index.

A document's score for an item is a sum of whole-number impacts, one for each term
of the item that it holds (BM25 with scaled weights and term shares).

Every task reads its documents' postings in blocks. In a block each term has an
impact list, highest first, and each document its own postings for direct access.
An item's lists are read in parallel, a stretch of positions at a time; each newly
met document is scored at once by direct accesses, which also mark its positions
in all other lists of the item. A list's best position ends its unbroken run of
marked positions; no unmet document can have more in that list than the impact
there after. When the sum of these over the lists is strictly below the kth score,
nothing unmet can enter, not even by a tie, and the item is done. The kth score is
carried from block to block of a task; the tasks' best k are merged at the end.

Defined results: null and empty texts have no terms, are never found and do not
count in N; an item without terms finds nothing; scores of 0 are left out; equal
scores go by id, null ids first; repeated documents hold a place each, and repeated
items (or item ids) are answered each; very long texts are read in slices and kept
as counts of the items' terms; other columns play no part; empty tables give none.

Scale: the corpus is read once for each block of items (a million terms; the items
are a stated query set), kept as eight bytes a posting of the items' terms and
never shuffled. A very frequent term is a long list in every task, never one group.
What is shuffled is k rows an item and task. The vocabulary, its document counts
and the items' terms are sent to the tasks, bounded by the block of items.
"""

from __future__ import annotations

import math
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatiofuse.llm.staging import staged
from spatiofuse.llm.terms import term_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP = 50
#: Production parameters of the score: weight of length in percent, and the saturation of repeated terms in thousandths.
LENGTH_PERCENT, SATURATION, SCALE = 50, 20, 1_000_000_000
#: Terms of a block of items, postings and documents of a block of the index, and positions first read of each list.
ITEM_TERMS, POSTINGS, DOCUMENTS, STRETCH = 1_000_000, 2_000_000, 65_536, 16
_LEAST = np.iinfo(np.int64).min


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(q, item, terms): every item row under a number of its own with its distinct terms."""
    def run(batches):
        for batch in batches:
            found = []
            for raw in batch.column(1):
                terms = set()
                for part in term_slices(raw.as_py()):
                    terms.update(part)
                found.append(sorted(terms))
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])

    kind = items.schema[item_id].dataType.simpleString()
    rows = items.select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("_x_text")).mapInArrow(run, f"item {kind}, terms array<binary>")
    return staged(rows.withColumn("q", F.monotonically_increasing_id()), "search-items")


def item_blocks(items: DataFrame, most: int):
    """Lists of (q, terms) whose terms number at most ``most``, or one item."""
    block, held = [], 0
    for q, terms in items.select("q", "terms").filter(F.size("terms") > 0).toLocalIterator():
        if block and held + len(terms) > most:
            yield block
            block, held = [], 0
        block.append((q, [bytes(t) for t in terms]))
        held += len(terms)
    if block:
        yield block


def postings(docs: DataFrame, id_col: str, text: str, vocabulary) -> DataFrame:
    """(id, n, terms, times): for documents with a term, their terms and how often they hold those of the (broadcast) vocabulary."""
    def run(batches):
        known = vocabulary.value
        for batch in batches:
            ids, sizes, terms, times = [], [], [], []
            for row, raw in enumerate(batch.column(1)):
                n, held = 0, Counter()
                for part in term_slices(raw.as_py()):
                    n += len(part)
                    counts = Counter(part)
                    for term in counts.keys() & known.keys():
                        held[known[term]] += counts[term]
                if not n:
                    continue
                ids.append(row)
                sizes.append(n)
                terms.append(np.array(list(held), "<i4").tobytes())
                times.append(np.array(list(held.values()), "<i4").tobytes())
            yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())],
                                  names=["id", "n", "terms", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("_x_text"))
    return staged(rows.mapInArrow(run, "id bigint, n bigint, terms binary, times binary"), "search-postings")


def flat(column, kind: str = "<i4") -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of bytes, and how many each row has."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), sizes


def term_weights(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the weight of each term of the vocabulary."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column(0))[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "df"])

    documents, length = (int(x or 0) for x in index.agg(F.count(F.lit(1)), F.sum("n")).first())
    weights = np.zeros(size, np.int64)
    for term, df in index.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    return documents, length, weights


class Block:
    """Impact lists by term and postings by document of some documents."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, documents: int, length: int, weights: np.ndarray):
        self.ids, self.nulls = ids, nulls
        distinct, back = np.unique(lengths, return_inverse=True)
        by_length = np.array([100 - LENGTH_PERCENT + LENGTH_PERCENT * n * documents // length for n in distinct.tolist()], np.int64)[back]
        doc = np.repeat(np.arange(len(ids)), sizes)
        times = times.astype(np.int64)
        impact = weights[terms] * (SCALE * times // (1000 * times + SATURATION * by_length[doc]))
        used = impact > 0
        self.terms, self.impact, doc = terms[used], impact[used], doc[used]
        self.bounds = np.searchsorted(doc, np.arange(len(ids) + 1))  # postings of each document
        order = np.lexsort((-self.impact, self.terms))
        self.list_docs, self.list_impact = doc[order], self.impact[order]
        self.lists = np.searchsorted(self.terms[order], np.arange(len(weights) + 1))  # postings of each term
        self.place = np.empty(len(order), np.int64)  # of a document's posting in the impact lists
        self.place[order] = np.arange(len(order))
        self.met, self.marked = np.zeros(len(ids), bool), np.zeros(len(order) + 1, bool)
        self.asked = np.zeros(len(weights), bool)

    def scored(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents for the asked terms by direct access, and the list places that these accesses meet."""
        first, size = self.bounds[docs], self.bounds[docs + 1] - self.bounds[docs]
        begin = np.cumsum(size) - size
        at = np.repeat(first - begin, size) + np.arange(size.sum())
        asked = self.asked[self.terms[at]]
        return np.add.reduceat(np.where(asked, self.impact[at], 0), begin), self.place[at[asked]]

    def search(self, terms: np.ndarray, best: "Best") -> int:
        """Offers to ``best`` all that can enter it; gives the number of documents met."""
        begin, end = self.lists[terms], self.lists[terms + 1]
        open_ = begin < end
        terms, begin, end = terms[open_], begin[open_], end[open_]
        if not len(terms):
            return 0
        self.asked[terms] = True
        unbroken, read, stretch, met, marked = begin.copy(), 0, STRETCH, [], []
        longest = int((end - begin).max())
        while read < longest:
            stop = read + stretch
            docs = np.concatenate([self.list_docs[b + read:min(b + stop, e)] for b, e in zip(begin.tolist(), end.tolist())])
            docs = np.unique(docs[~self.met[docs]])
            if len(docs):
                self.met[docs] = True
                scores, places = self.scored(docs)
                self.marked[places] = True
                met.append(docs)
                marked.append(places)
                best.offer(scores, self.ids[docs], self.nulls[docs])
            bound = 0
            for i, (u, e) in enumerate(zip(unbroken.tolist(), end.tolist())):
                if u < e:
                    gap = int(np.argmin(self.marked[u:e]))
                    if self.marked[u + gap]:  # all of the rest
                        unbroken[i] = e
                    else:
                        unbroken[i] = u + gap
                        bound += int(self.list_impact[u + gap])
            if bound < best.least:
                break
            read, stretch = stop, 2 * stretch
        self.asked[terms] = False
        for docs, places in zip(met, marked):
            self.met[docs] = False
            self.marked[places] = False
        return sum(map(len, met))


class Best:
    """The best ``k`` documents of an item so far; equal scores by id, null ids first."""

    def __init__(self, k: int):
        self.k, self.least = k, 1  # a score of 0 never enters
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        scores, ids, nulls = (np.concatenate(p) for p in ((self.scores, scores[good]), (self.ids, ids[good]), (self.nulls, nulls[good])))
        order = np.lexsort((ids, ~nulls, -scores))[:self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def block_results(index: DataFrame, items: list, shared, k: int) -> DataFrame:
    """(q, id, score): each task's best ``k`` documents of every item."""
    def run(batches):
        queries, documents, length, weights = shared.value
        best = [Best(k) for _ in queries]
        held, n_docs, n_postings = [], 0, 0

        def search():
            ids, sizes, terms, times = pa.concat_arrays([b.column(0) for b in held]), [], [], []
            for b in held:
                t, size = flat(b.column(2))
                terms.append(t)
                sizes.append(size)
                times.append(flat(b.column(3))[0])
            lengths = np.concatenate([b.column(1).to_numpy() for b in held])
            block = Block(pc.fill_null(ids, _LEAST).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), lengths, np.concatenate(sizes), np.concatenate(terms),
                          np.concatenate(times), documents, length, weights)
            for mine, (_, asked) in zip(best, queries):
                block.search(asked, mine)

        for batch in batches:
            held.append(batch)
            n_docs += batch.num_rows
            n_postings += (pc.sum(pc.binary_length(batch.column(2))).as_py() or 0) // 4
            if n_docs >= DOCUMENTS or n_postings >= POSTINGS:
                search()
                held, n_docs, n_postings = [], 0, 0
        if n_docs:
            search()
        for mine, (q, _) in zip(best, queries):
            if len(mine.scores):
                yield pa.record_batch([pa.array(np.full(len(mine.scores), q), pa.int64()), pa.array(mine.ids, pa.int64(), mask=mine.nulls), pa.array(mine.scores, pa.int64())], names=["q", "id", "score"])

    return index.mapInArrow(run, "q bigint, id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``k`` highest-scoring documents of every item. Ids of documents are whole numbers."""
    context = docs.sparkSession.sparkContext
    asked = item_terms(items, item_id, item_text)
    found = None
    for block in item_blocks(asked, ITEM_TERMS):
        vocabulary = {}
        queries = [(q, np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms], np.int64)) for q, terms in block]
        index = postings(docs, id_col, text, context.broadcast(vocabulary))
        documents, length, weights = term_weights(index, len(vocabulary))
        part = block_results(index, block, context.broadcast((queries, documents, length, weights)), k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "q bigint, id bigint, score bigint")
    order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item"), "q").select("item", F.col("rank").cast("int").alias("rank"), "id", "score")
