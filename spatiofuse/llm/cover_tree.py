"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are cut into clusters around sampled centres and clusters into blocks of
bounded size; queries likewise. Each block is a node with a centre and a covering
radius; inside a block a cover tree (each level's nodes cover their members within
half the radius of the level above) is built for queries and data alike. For a pair
of nodes no inner product can exceed

    <cq, cp> + |cq| rp + |cp| rq + rq rp,

so a pair is pruned when that is under the worst kth score of the query group.
Work is in three steps: every query block first searches the data block nearest to
it, which gives every query a kth score to start from; the pairs of blocks whose
bound reaches the group's worst score are listed; each such pair is one small task
for the dual-tree search. The partial results of a query are merged by rank.

Scores are integers: vectors are scaled and floored first. Ties go to the smaller id.

Defined results: vectors that are null, empty or hold a null or non-finite component
take no part; shorter vectors count as padded with zeros; a query with fewer than k
candidates returns all; repeated ids are candidates each, but never for a query of the same
id; null ids take no part; other columns play no part; no query or no data gives an empty table.

Scale: the centres are a bounded sample (``CENTRES``) and only shape the tree: every
row is indexed. Hot clusters (a third of all rows may be one vector) are cut into
blocks by hash. Only pairs of block summaries, never of rows, are listed.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatiofuse.llm.staging import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, K = 1024, 10
#: Sampled centres; rows of a data block and of a query block; vectors of a leaf.
CENTRES, DATA_BLOCK, QUERY_BLOCK, LEAF = 32, 4096, 512, 64
SEED = 17


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def scaled(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def matrix(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


class Node:
    __slots__ = ("rows", "centre", "norm", "radius", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: np.ndarray, leaf: int):
        self.rows, self.centre, self.children = rows, centre, []
        distance = np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))
        self.radius, self.norm = float(distance.max()) * (1 + 1e-12), float(np.sqrt((centre ** 2).sum()))
        if len(rows) <= leaf or self.radius == 0:
            return
        # cover: points at least half the radius apart, each row under its nearest; few, so that leaves stay filled
        chosen, nearest, owner = [rows[int(distance.argmin())]], np.full(len(rows), np.inf), np.zeros(len(rows), int)
        while True:
            d = np.sqrt(((points[rows] - points[chosen[-1]]) ** 2).sum(axis=1))
            closer = d < nearest
            nearest[closer], owner[closer] = d[closer], len(chosen) - 1
            far = int(nearest.argmax())
            if nearest[far] <= self.radius / 2 or len(chosen) * leaf >= 2 * len(rows):
                break
            chosen.append(rows[far])
        if len(chosen) == 1:
            return
        for i, c in enumerate(chosen):
            members = rows[owner == i]
            if len(members):
                self.children.append(Node(points, members, points[c].astype(float), leaf))


def tree_of(points: np.ndarray, leaf: int = LEAF) -> Node:
    real = points.astype(float)
    return Node(real, np.arange(len(real)), real.mean(axis=0), leaf)


def bound(q: Node, p: Node) -> float:
    """No inner product between the nodes' rows exceeds it (with room for rounding)."""
    b = float(q.centre @ p.centre) + q.norm * p.radius + p.norm * q.radius + q.radius * p.radius
    return b + 1e-9 * abs(b) + 1e-6


class Best:
    """k best (score, -id) of every query, and the worst of each."""

    def __init__(self, query_ids, k: int, floor):
        self.ids, self.k, self.kept = query_ids, k, [[] for _ in query_ids]
        self.worst = np.array(floor, float)  # kth scores known beforehand: equal ones still count

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray):
        for at, i in enumerate(rows):
            line, heap = scores[at], self.kept[i]
            # the query's own rows go first; of the others no more than k and their ties can enter
            good = np.flatnonzero((line >= self.worst[i]) & (ids != self.ids[i]))
            if len(good) > self.k:
                cut = np.partition(line[good], len(good) - self.k)[len(good) - self.k] if len(good) > 4 * self.k else None
                good = good if cut is None else good[line[good] >= cut]
                good = good[np.lexsort((ids[good], -line[good]))][:self.k]
            for j in good:
                entry = (int(line[j]), -int(ids[j]))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.worst[i] = max(self.worst[i], heap[0][0])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where all sums are below 2 ** 53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2 ** 53 else a @ b.T


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, floor=None) -> Best:
    """Dual-tree search of one block of queries in one block of data."""
    best = Best(query_ids, k, np.full(len(queries), -np.inf) if floor is None else floor)
    q_root, p_root = tree_of(queries), tree_of(data)
    order, heap = 0, [(-bound(q_root, p_root), 0, q_root, p_root)]
    while heap:
        minus, _, q, p = heapq.heappop(heap)
        if -minus < best.worst[q.rows].min():
            continue
        if not q.children and not p.children:
            best.offer(q.rows, ids[p.rows], products(queries[q.rows], data[p.rows]))
            continue
        split = q if q.children and (not p.children or q.radius >= p.radius) else p
        for child in split.children:
            pair = (child, p) if split is q else (q, child)
            b = bound(*pair)
            if b >= best.worst[pair[0].rows].min():
                order += 1
                heapq.heappush(heap, (-b, order, *pair))
    return best


def _summaries(blocks: DataFrame, width: int) -> DataFrame:
    """(block, n, centre, radius) of every block."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = matrix(pdf["v"].tolist(), width).astype(float)
        centre = m.mean(axis=0)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "centre": [centre.tolist()], "radius": [float(np.sqrt(((m - centre) ** 2).sum(axis=1)).max())]})
    return blocks.groupBy("block").applyInPandas(run, "block string, centre array<double>, radius double")


def _blocked(rows: DataFrame, centres: np.ndarray, width: int, size: int) -> DataFrame:
    """(id, v, block): clusters by nearest centre, large ones cut by hash into blocks of about ``size``."""
    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        m = matrix(v.tolist(), width).astype(float)
        return pd.Series(((centres ** 2).sum(axis=1)[None, :] - 2 * m @ centres.T).argmin(axis=1))

    clustered = staged(rows.withColumn("cluster", nearest("v")), "topk-clusters")
    sizes = clustered.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / size).alias("cuts"))  # CENTRES rows
    part = F.pmod(F.xxhash64("id", "v"), F.col("cuts"))
    return clustered.join(F.broadcast(sizes), "cluster").select("id", "v", F.concat_ws("-", "cluster", part).alias("block"))


def _searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, id, score): the best of each listed pair of blocks. ``queries`` has the kth score known so far, ``floor``."""
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        best = search(matrix(left["v"].tolist(), width), left["id"].to_numpy(), matrix(right["v"].tolist(), width), right["id"].to_numpy(), k, left["floor"].fillna(-np.inf).to_numpy(float))
        rows = [(q, -i, s) for q, heap in zip(best.ids, best.kept) for s, i in heap]
        return pd.DataFrame(rows, columns=["query_id", "id", "score"])

    left = pairs.join(queries.withColumnRenamed("block", "q_block"), "q_block").select(F.col("q_block").alias("lq"), F.col("d_block").alias("ld"), "id", "v", "floor")
    right = pairs.join(data.withColumnRenamed("block", "d_block"), "d_block").select(F.col("q_block").alias("rq"), F.col("d_block").alias("rd"), "id", "v")
    return left.groupBy("lq", "ld").cogroup(right.groupBy("rq", "rd")).applyInPandas(run, "query_id bigint, id bigint, score bigint")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score) of the k best candidates of every query row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("raw"), is_query.alias("q")).filter(F.col("id").isNotNull() & usable(F.col("raw")))
    rows = staged(rows.select("id", "q", scaled(F.col("raw"), scale).alias("v")), "topk-rows")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    sample = rows.select("v", F.xxhash64(F.lit(SEED), "id").alias("r")).orderBy("r", "v").limit(CENTRES).select("v").collect()
    centres = np.unique(matrix([r["v"] for r in sample], width), axis=0).astype(float) if sample else np.zeros((1, width))
    data = staged(_blocked(rows.select("id", "v"), centres, width, DATA_BLOCK), "topk-data")
    queries = staged(_blocked(rows.filter("q").select("id", "v"), centres, width, QUERY_BLOCK).dropDuplicates(["id", "v"]), "topk-queries")
    d_nodes = staged(_summaries(data, width), "topk-data-nodes")
    q_nodes = staged(_summaries(queries, width), "topk-query-nodes")

    # every block of queries against the summaries of all blocks of data
    numbered = d_nodes.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(PARTS)))
    pairs = (q_nodes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).alias("q").join(numbered.alias("d"), "part")
             .select(F.col("q.block").alias("q_block"), F.col("d.block").alias("d_block"), "q.centre", "q.radius", F.col("d.centre").alias("d_centre"), F.col("d.radius").alias("d_radius")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    most = dot("centre", "d_centre") + norm("centre") * F.col("d_radius") + norm("d_centre") * F.col("radius") + F.col("radius") * F.col("d_radius")
    pairs = staged(pairs.select("q_block", "d_block", (most + F.abs(most) * 1e-9 + 1e-6).alias("most"), dot("centre", "d_centre").alias("near")), "topk-pairs")

    first = ranked_pairs(pairs)
    start = staged(_searched(first, queries.withColumn("floor", F.lit(None).cast("double")), data, width, k), "topk-first")
    floors = ranked(start, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).cast("double").alias("floor"))
    known = staged(queries.join(floors.withColumnRenamed("query_id", "id"), "id", "left"), "topk-known")
    worst = known.groupBy("block").agg(F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("worst")).withColumnRenamed("block", "q_block")
    open_pairs = pairs.join(first, ["q_block", "d_block"], "left_anti").join(worst, "q_block").filter(F.col("most") >= F.col("worst")).select("q_block", "d_block")
    rest = _searched(staged(open_pairs, "topk-open"), known, data, width, k)
    return ranked(start.unionByName(rest), k).select("query_id", "rank", "id", "score")


#: Slices that the data summaries are cut into where they meet the query summaries.
PARTS = 16


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """For each block of queries the data block of the largest inner product of centres."""
    order = W.partitionBy("q_block").orderBy(F.desc("near"), "d_block")
    return pairs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("q_block", "d_block")
