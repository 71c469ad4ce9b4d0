"""A count-balanced quadtree over pool rows, and the leaves that can hold a probe's k nearest.

The tree is built bottom-up from the counts of cells of ten sizes: a cell is split only where it holds more
than ``CAPACITY`` rows, so a city has many small leaves and empty land none. A leaf is one
row of a small table: its range of Morton codes, a disc around its rows, and counts.
Rows find their leaf by range, with one binary search.

A probe's candidates are the leaves whose disc comes nearer than a bound on its k-th
distance; the bound is where the nearest discs, taken whole, hold k rows. Leaves are
pruned by runs of 16 along the Morton curve first.

The leaf table (about one row for twenty pool rows, 64 bytes) is sent to the tasks only
where its count is at most ``MOST_LEAVES``; ``build`` gives None beyond that.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiofuse.constants import EARTH_RADIUS_KM

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Finest level (cells of about 150 m) and rows from which a cell is split.
FINEST, CAPACITY = 18, 12
#: Leaves of a tree that is sent to the tasks, leaves of a run, and numbers compared at a time.
MOST_LEAVES, RUN, PAIRS = 500_000, 16, 2_000_000
SLACK = 1e-9
#: Neighbouring leaves of a tile.
TILE_LEAVES = 64
_STEP = 2  # levels of the tree are two halvings apart


def cell_index(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the finest cells; columns wrap at 180 degrees."""
    size = 360.0 / 2**FINEST
    return np.floor((lat + 90.0) / size).astype(np.int64), np.floor((lon + 180.0) / size).astype(np.int64) % 2**FINEST


def morton(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits of row and column, interleaved."""
    out = np.zeros(len(i), np.int64)
    for bit in range(FINEST):
        out |= ((i >> bit) & 1) << (2 * bit + 1) | ((j >> bit) & 1) << (2 * bit)
    return out


def arcs(lat1, lon1, lat2, lon2, metric: str) -> np.ndarray:
    """Distance as the joins measure it: kilometres on the sphere or degrees in the plane."""
    if metric == "degree":
        return np.sqrt((lat1 - lat2) ** 2 + (lon1 - lon2) ** 2)
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon1 - lon2) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))


def discs(south, north, west, east, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre and radius of discs that hold the given boxes."""
    lat, lon, dlat, dlon = (south + north) / 2, (west + east) / 2, (north - south) / 2, (east - west) / 2
    if metric == "degree":
        return lat, lon, np.sqrt(dlat ** 2 + dlon ** 2) * (1 + SLACK) + 1e-12
    widest = np.where((south <= 0) & (north >= 0), 1.0, np.cos(np.radians(np.minimum(np.abs(south), np.abs(north)))))
    chord = np.sqrt(np.radians(dlat) ** 2 + (widest * np.radians(dlon)) ** 2) / 2
    return lat, lon, 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(chord, 1.0)) * (1 + SLACK) + 1e-9


@dataclass
class Group:
    """Leaves of one group of rows in Morton order, and their runs."""

    first: int
    low: np.ndarray
    high: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    radius: np.ndarray
    sure: np.ndarray
    runs: tuple | None = None

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        """Number of the leaf whose range holds each code; -1 for none."""
        at = np.searchsorted(self.low, codes, side="right") - 1
        inside = (at >= 0) & (codes < self.high[np.maximum(at, 0)])
        return np.where(inside, self.first + at, -1)

    def candidates(self, lat: np.ndarray, lon: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe, leaf) pairs that can hold one of the probe's k nearest rows, by probe; and each probe's reach: rows of other leaves lie beyond it."""
        reach = np.full(len(lat), np.inf)
        if self.runs is None:
            probe, leaf = np.repeat(np.arange(len(lat)), len(self.lat)), np.tile(np.arange(len(self.lat)), len(lat))
        else:
            r_lat, r_lon, r_radius, r_sure = self.runs
            d = arcs(lat[:, None], lon[:, None], r_lat, r_lon, metric)
            bound = np.where(r_sure >= k, d + r_radius, np.inf).min(1)
            reach = bound
            probe, run = np.nonzero(d - r_radius <= bound[:, None] * (1 + SLACK))
            size = np.minimum(RUN, len(self.lat) - run * RUN)
            begin = np.cumsum(size) - size
            leaf = np.repeat(run * RUN - begin, size) + np.arange(size.sum())
            probe = np.repeat(probe, size)
        d = arcs(lat[probe], lon[probe], self.lat[leaf], self.lon[leaf], metric)
        far = d + self.radius[leaf]
        order = np.lexsort((far, probe))
        held = np.cumsum(self.sure[leaf[order]])
        starts = np.searchsorted(probe[order], np.arange(len(lat)))
        before = np.concatenate([[0], held])[starts]
        enough = held - before[probe[order]] >= k
        bound = np.full(len(lat), np.inf)
        np.minimum.at(bound, probe[order][enough], far[order][enough])
        near = d - self.radius[leaf] <= bound[probe] * (1 + SLACK)
        return probe[near], self.first + leaf[near], np.minimum(bound, reach)


class Tree:
    """All groups' leaves, as they are sent to the tasks."""

    def __init__(self, table: pd.DataFrame, metric: str):
        self.metric, self.groups = metric, {}
        halvings = FINEST - table["m"].to_numpy(np.int64)
        low = morton(table["ai"].to_numpy(np.int64) << halvings, table["aj"].to_numpy(np.int64) << halvings)
        table = table.assign(low=low, high=low + (np.int64(1) << 2 * halvings)).sort_values(["key", "low"], kind="stable")
        first = 0
        for key, part in table.groupby("key", sort=False):
            box = [part[c].to_numpy() for c in ("south", "north", "west", "east")]
            sure = part["sure"].to_numpy()
            group = Group(first, part["low"].to_numpy(), part["high"].to_numpy(), *discs(*box, metric), sure)
            if len(part) > 4 * RUN:
                cut = np.arange(0, len(part), RUN)
                ends = [f.reduceat(b, cut) for f, b in zip((np.minimum, np.maximum, np.minimum, np.maximum), box)]
                group.runs = (*discs(*ends, metric), np.add.reduceat(sure, cut))
            self.groups[key] = group
            first += len(part)


def _by_group(keys: pd.Series):
    for key, at in keys.groupby(keys, sort=False).indices.items():
        yield key, at


def group_key(on: list[str]) -> Column:
    """Text of the group columns; NULL where one is NULL, as such rows meet nothing."""
    return F.concat(F.lit(""), *[F.concat(F.col(c).cast("string"), F.lit("\x1f")) for c in on])


def build(pool: DataFrame, on: list[str], lat: str, lon: str, metric: str, side: str | None = None) -> Tree | None:
    """The tree of ``pool``; with ``side``, a leaf is sure of its rows less the most that one value of ``side`` has there."""
    size = 360.0 / 2**FINEST
    i, j = F.floor((F.col(lat) + 90.0) / size).cast("long"), F.pmod(F.floor((F.col(lon) + 180.0) / size).cast("long"), F.lit(2**FINEST))
    rows = pool.select(group_key(on).alias("key"), i.alias("i"), j.alias("j"), F.col(lat).alias("y"), F.col(lon).alias("x"), *([F.col(side).alias("side")] if side else []))
    sides = ["side"] if side else []
    levels = F.array(*[F.struct(F.lit(m).alias("m"), F.shiftright("i", FINEST - m).alias("ai"), F.shiftright("j", FINEST - m).alias("aj")) for m in range(FINEST, -1, -_STEP)])
    nodes = (rows.filter(F.col("key").isNotNull()).withColumn("_l", F.explode(levels)).groupBy("key", "_l.m", "_l.ai", "_l.aj", *sides)
             .agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("south"), F.max("y").alias("north"), F.min("x").alias("west"), F.max("x").alias("east")))
    if side:
        nodes = nodes.groupBy("key", "m", "ai", "aj").agg(F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("sure"),
            F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"))
    else:
        nodes = nodes.withColumn("sure", F.col("n"))
    split = nodes.filter((F.col("n") > CAPACITY) & (F.col("m") < FINEST)).select(
        "key", (F.col("m") + _STEP).alias("m"), F.col("ai").alias("pi"), F.col("aj").alias("pj"))
    ends = nodes.filter((F.col("n") <= CAPACITY) | (F.col("m") == FINEST)).withColumns({"pi": F.shiftright("ai", _STEP), "pj": F.shiftright("aj", _STEP)})
    leaves = ends.filter("m = 0").drop("pi", "pj").unionByName(ends.filter("m > 0").join(split, ["key", "m", "pi", "pj"], "left_semi").drop("pi", "pj"))
    table = leaves.select("key", "m", "ai", "aj", "sure", "south", "north", "west", "east").limit(MOST_LEAVES + 1).toPandas()
    return Tree(table, metric) if len(table) <= MOST_LEAVES else None


def leaf_column(tree, on: list[str], lat: str, lon: str) -> Column:
    """Leaf number of a row (``tree`` is a broadcast Tree)."""
    @F.pandas_udf("int")
    def found(key: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.Series:
        out = np.full(len(key), -1, np.int32)
        codes = morton(*cell_index(lat.to_numpy(), lon.to_numpy()))
        for name, at in _by_group(key):
            group = tree.value.groups.get(name)
            if group is not None:
                out[at] = group.leaf_of(codes[at])
        return pd.Series(out)

    return found(group_key(on), F.col(lat), F.col(lon))


def candidate_leaves(tree, on: list[str], lat: str, lon: str, k: int) -> Column:
    """Array of the leaves that can hold one of a row's k nearest."""
    @F.pandas_udf("array<int>")
    def found(key: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.Series:
        out = np.empty(len(key), object)
        out[:] = [np.zeros(0, np.int32)] * len(key)
        y, x = lat.to_numpy(), lon.to_numpy()
        for name, at in _by_group(key):
            group = tree.value.groups.get(name)
            if group is None:
                continue
            width = len(group.lat) if group.runs is None else len(group.runs[0])
            step = max(1, PAIRS // max(width, 1))
            for s in range(0, len(at), step):
                part = at[s:s + step]
                probe, leaf, _ = group.candidates(y[part], x[part], k, tree.value.metric)
                for p, own in zip(part, np.split(leaf.astype(np.int32), np.searchsorted(probe, np.arange(1, len(part))))):
                    out[p] = own
        return pd.Series(out)

    return found(group_key(on), F.col(lat), F.col(lon))


def homes(tree, lat: str, lon: str, k: int) -> Column:
    """Tile of a place, the leaves that can hold its k nearest places, and its reach (rows of other leaves lie beyond); for a tree of one group."""
    @F.pandas_udf("tile int, reach double, leaves array<int>")
    def found(lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
        y, x, group = lat.to_numpy(), lon.to_numpy(), tree.value.groups.get("")
        tile, reach, leaves = np.zeros(len(y), np.int32), np.full(len(y), np.inf), np.empty(len(y), object)
        leaves[:] = [np.zeros(0, np.int32)] * len(y)
        if group is not None:
            tile = (np.maximum(np.searchsorted(group.low, morton(*cell_index(y, x)), side="right") - 1, 0) // TILE_LEAVES).astype(np.int32)
            step = max(1, PAIRS // len(group.lat if group.runs is None else group.runs[0]))
            for s in range(0, len(y), step):
                probe, leaf, reach[s:s + step] = group.candidates(y[s:s + step], x[s:s + step], k, tree.value.metric)
                for p, own in enumerate(np.split(leaf.astype(np.int32), np.searchsorted(probe, np.arange(1, len(y[s:s + step]))))):
                    leaves[s + p] = own
        return pd.DataFrame({"tile": tile, "reach": reach, "leaves": leaves})

    return found(F.col(lat), F.col(lon))


def picker(keep: list[str], carried: list[str], k: int, metric: str, side: str | None):
    """A function of one tile's probes and rows: ``keep`` of every probe and ``_near``, the rows (``carried``) that can be its k nearest.

    Those are the k nearest rows and whatever lies within rounding of the last of them.
    """
    def axes(lat: np.ndarray, lon: np.ndarray) -> list[np.ndarray]:
        if metric == "degree":
            return [lat, lon]
        a, b = np.radians(lat), np.radians(lon)
        return [np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)]

    def pick(probes: pa.Table, rows: pa.Table) -> pa.Table:
        q = axes(probes["lat"].to_numpy().astype(float), probes["lon"].to_numpy().astype(float))
        p = axes(rows["p_lat"].to_numpy().astype(float), rows["p_lon"].to_numpy().astype(float))
        m, n = len(q[0]), len(p[0])
        if side:
            same = pd.factorize(pd.concat([probes[side].to_pandas(), rows[f"p_{side}"].to_pandas()], ignore_index=True))[0]
        counts, taken = np.zeros(m, np.int64), []
        step = max(1, PAIRS // max(n, 1))
        for s in range(0, m if n else 0, step):
            d = np.sqrt(sum((a[s:s + step, None] - b) ** 2 for a, b in zip(q, p)))
            if side:
                d[same[:m][s:s + step, None] == same[m:]] = np.inf
            last = np.partition(d, k - 1, axis=1)[:, k - 1] if n > k else np.full(len(d), np.inf)
            probe, row = np.nonzero((d <= last[:, None] * (1 + SLACK) + 1e-12) & np.isfinite(d))
            counts[s:s + step] = np.bincount(probe, minlength=len(d))
            taken.append(row)
        at = pa.array(np.concatenate(taken) if taken else np.zeros(0, np.int64))
        values = rows.select(carried).take(at).to_struct_array()
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return probes.select(keep).append_column("_near", pa.ListArray.from_arrays(ends, values))

    return pick
