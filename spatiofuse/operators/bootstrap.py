"""Percentile bootstrap confidence intervals by resampling cluster totals.

A draw picks as many clusters as there are, with replacement, by a hash of (draw, slot).

With ``poisson`` a draw gives every cluster a Poisson(1) weight instead, the limit of how
often one of many clusters is picked. The weight comes from a hash of (draw, cluster)
that is pairwise independent, so a draw needs no list of picks and no join: each task
adds weight x totals of its clusters into one array of draws, and the arrays are summed.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiofuse.functions.ordering import hash_int, shuffle_key, whole_rank
from spatiofuse.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PRIME = 2**31 - 1
#: Hash values from which the Poisson(1) weight is at least 1, 2, ... (its distribution function, scaled).
STEPS = [math.floor(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(10)]
#: Clusters weighed at a time.
_CHUNK = 2048
#: Draws that one row stands for while the picks are dealt to tasks.
_DRAWS = 50


def draw_constants(n_boot: int, seed) -> np.ndarray:
    """Multiplier and offset of each draw's hash, two rows."""
    digests = [hashlib.md5(f"{seed}:{b}".encode()).hexdigest() for b in range(n_boot)]
    return np.array([[int(d[:8], 16) % (PRIME - 1) + 1 for d in digests], [int(d[8:16], 16) % PRIME for d in digests]], np.int64).reshape(2, n_boot)


def weights(keys: np.ndarray, constants: np.ndarray) -> np.ndarray:
    """Poisson(1) weights: a row for each cluster key, a column for each draw."""
    h = (keys[:, None] * constants[0] + constants[1]) % PRIME
    return np.searchsorted(STEPS, h.ravel(), side="right").reshape(h.shape)


def _clusters(df: DataFrame, cluster: str | None, row_key: list[str], totals: dict[str, Column], seed) -> DataFrame:
    """One row of totals per cluster, its ``slot`` (1..C in seeded order) and its ``key`` below ``PRIME``.

    With no cluster column, or a single cluster, rows are their own clusters.
    """
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in row_key])
    if cluster is None:
        label = row
    else:
        distinct = df.select(F.count_distinct(cluster)).scalar()
        label = F.when(distinct < 2, row).otherwise(F.col(cluster).cast("string"))
    stats = df.groupBy(label.alias("_cluster")).agg(*[e.alias(k) for k, e in totals.items()])
    ranked = whole_rank(stats.withColumn("_key", shuffle_key(f"{seed}:cluster", "_cluster")), "_key", "slot")
    return cut_lineage(ranked.withColumn("key", hash_int(F.col("_key")) % PRIME).drop("_key", "_cluster"))


def _resampled(clusters: DataFrame, names: list[str], n_boot: int, seed, poisson: bool) -> DataFrame:
    """(b, totals) of each draw: C clusters picked with replacement by hash, or Poisson weights.

    Each cluster row emits one pick per draw, so the draws are spread like the clusters.
    """
    if poisson:
        return _weighed(clusters, names, n_boot, seed)
    count = clusters.count()
    dealt = clusters.select("slot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(_DRAWS))).alias("_first")).repartition("slot", "_first")
    draws = dealt.select("slot", F.explode(F.sequence("_first", F.least(F.col("_first") + _DRAWS, F.lit(n_boot)) - 1)).alias("b"))
    picks = draws.select("b", (hash_int(shuffle_key(seed, "b", "slot")) % count + 1).alias("slot"))
    # picks of a slot are as many as draws on average, so the clusters are the small side of every task
    return picks.join(clusters.hint("shuffle_hash"), "slot").groupBy("b").agg(*[F.sum(c).alias(c) for c in names])


def _weighed(clusters: DataFrame, names: list[str], n_boot: int, seed) -> DataFrame:
    """(b, totals) of each draw by Poisson weights: one pass over the clusters, ``n_boot`` rows out of every task."""
    constants = draw_constants(n_boot, seed)

    def run(batches):
        sums, met = np.zeros((n_boot, len(names))), False
        for batch in batches:
            met = met or batch.num_rows > 0
            keys = batch.column(0).to_numpy()
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
            for at in range(0, len(keys), _CHUNK):
                sums += weights(keys[at:at + _CHUNK], constants).T.astype(float) @ values[at:at + _CHUNK]
        if met:
            yield pa.record_batch([pa.array(np.arange(n_boot)), *[pa.array(sums[:, i]) for i in range(len(names))]], names=["b", *names])

    parts = clusters.select("key", *names).mapInArrow(run, "b bigint, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("b").agg(*[F.sum(c).alias(c) for c in names])


def _interval(column: str, name: str, level: float = 0.95) -> list[Column]:
    tail = (1.0 - level) / 2.0
    q = F.percentile(column, F.array(F.lit(tail), F.lit(1.0 - tail)))  # one value per draw
    return [q[0].alias(f"{name}_lo"), q[1].alias(f"{name}_hi")]


def bootstrap_ci(df: DataFrame, y: str, pred: str, cluster: str | None = None,
                 row_key: list[str] = ("sensor_id", "date"), n_boot: int = 1000, seed=0, poisson: bool = False) -> DataFrame:
    """95 % intervals of R² and RMSE; draws without variance are ignored for R²."""
    ok = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    mean = ok.select(F.avg(y)).scalar()
    t, e = F.col(y) - mean, F.col(pred) - F.col(y)
    totals = {"n": F.count(F.lit(1)), "sy": F.sum(t), "sy2": F.sum(t * t), "se2": F.sum(e * e)}
    draws = _resampled(_clusters(ok, cluster, list(row_key), totals, seed), list(totals), n_boot, seed, poisson)
    ss_tot = F.col("sy2") - F.col("sy") * F.col("sy") / F.col("n")
    draws = draws.select(F.when(ss_tot > 0, F.lit(1.0) - F.col("se2") / ss_tot).alias("r2"),
                         F.when(F.col("n") > 0, F.sqrt(F.col("se2") / F.col("n"))).alias("rmse"))
    return draws.agg(*_interval("r2", "r2"), *_interval("rmse", "rmse"), F.count(F.lit(1)).alias("n_boot"))


def paired_delta_r2(df: DataFrame, y: str, ref: str, alt: str, cluster: str = "sensor_id",
                    row_key: list[str] = ("sensor_id", "date"), n_boot: int = 1000, seed=0, poisson: bool = False) -> DataFrame:
    """R²(alt) − R²(ref) on shared rows with its cluster-bootstrap interval."""
    ok = df.filter(F.col(y).isNotNull() & F.col(ref).isNotNull() & F.col(alt).isNotNull())
    mean = ok.select(F.avg(y)).scalar()
    t, er, ea = F.col(y) - mean, F.col(ref) - F.col(y), F.col(alt) - F.col(y)
    totals = {"n": F.count(F.lit(1)), "sy": F.sum(t), "sy2": F.sum(t * t), "sr2": F.sum(er * er), "sa2": F.sum(ea * ea)}
    clusters = _clusters(ok, cluster, list(row_key), totals, seed)
    draws = _resampled(clusters, list(totals), n_boot, seed, poisson)

    def delta(sy, sy2, n, sr2, sa2):
        ss_tot = sy2 - sy * sy / n
        return F.when(ss_tot > 0, (sr2 - sa2) / ss_tot)

    cols = [F.col(c) for c in ("sy", "sy2", "n", "sr2", "sa2")]
    ci = draws.select(delta(*cols).alias("d")).agg(*_interval("d", "ci"), F.lit(1).alias("_j"))
    point = clusters.agg(
        delta(F.sum("sy"), F.sum("sy2"), F.sum("n"), F.sum("sr2"), F.sum("sa2")).alias("delta_r2"),
        F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_rows"), F.lit(1).alias("_j"))
    return point.join(ci, "_j").drop("_j")  # one row each
