"""Quantiles of the rows that share a forest's leaves, merged in the tasks from one table of the forest's size."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points that stand for the target's distribution in a leaf, each for as many of its rows.
POINTS = 64
_ROWS = 500  # rows merged at a time in one task
_SHIFT = 31  # bits of a leaf's row count in a key


def leaf_table(sketches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys by (tree, leaf, point) and all points in order, from (tree, leaf, sketch).

    A key is a point's place in the order, then its leaf's row count; a leaf without rows has key 0. The table has
    trees x leaves x ``POINTS`` numbers, whatever the number of rows.
    """
    ranks = F.array(*[F.lit((i + 0.5) / POINTS) for i in range(POINTS)])
    found = sketches.select("tree", "leaf", F.kll_sketch_get_n_double("sketch").alias("n"), F.kll_sketch_get_quantile_double("sketch", ranks).alias("points")).toArrow()
    tree, leaf, n = (found[c].to_numpy().astype(np.int64) for c in ("tree", "leaf", "n"))
    points = found["points"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(points, kind="stable")
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    keys = np.zeros((tree.max(initial=-1) + 1, leaf.max(initial=-1) + 1, POINTS), np.int64)
    keys[tree, leaf] = (place.reshape(-1, POINTS) << _SHIFT) | n[:, None]
    return keys, points[order]


def merged_quantiles(leaves: DataFrame, table: tuple[np.ndarray, np.ndarray], quantiles, keep: list[str]) -> DataFrame:
    """``keep`` and q05, q50, ... of each row of ``leaves`` (``keep`` and ``_leaf``, the leaf of every tree): no row is shuffled."""
    shared = leaves.sparkSession.sparkContext.broadcast(table)
    names = [f"q{round(q * 100):02d}" for q in quantiles]
    levels = [float(q) for q in quantiles]

    def run(batches):
        keys, values = shared.value
        trees = np.arange(len(keys))
        for batch in batches:
            at = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
            out = np.empty((len(levels), batch.num_rows))
            for lo in range(0, batch.num_rows, _ROWS):
                met = keys[trees, at[lo:lo + _ROWS]].reshape(-1, keys.shape[0] * keys.shape[2])
                met.sort(axis=1)
                held = (met & ((1 << _SHIFT) - 1)).cumsum(axis=1)
                for i, q in enumerate(levels):
                    first = np.minimum((held < q * held[:, -1:]).sum(axis=1), met.shape[1] - 1)
                    out[i, lo:lo + _ROWS] = values[met[np.arange(len(met)), first] >> _SHIFT]
            yield pa.record_batch([*batch.columns[:-1], *(pa.array(o) for o in out)], names=[*keep, *names])

    kinds = [f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in keep]
    return leaves.select(*keep, "_leaf").mapInArrow(run, ", ".join([*kinds, *(f"{c} double" for c in names)]))
