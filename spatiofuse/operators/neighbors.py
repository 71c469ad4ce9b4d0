"""Same-day multi-radius neighbour aggregates (mean, count, spread within 25/50/100 km).

The range join is an equi-join on (date, cell) with an exact distance filter,
over *distinct places*: copies at one place are collapsed to (n, sum, sum of
squares) first, and rows at one place share one probe. Where a pair of cells
holds more point pairs than ``pair_limit``, places are compared once for all days
of a month: cells are split until none holds many places, each query cell meets the
pool cells near it in one group, and memberships times the days' totals (a matrix
product) give the sums. There, blocks of neighbouring places that lie wholly within a
radius count by their totals, and only blocks that its circle cuts are compared place
by place. Nothing is capped.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiofuse.constants import ANCHOR_RADIUS_KM, EARTH_RADIUS_KM, KM_PER_DEGREE, NEIGHBOR_COLUMNS, NEIGHBOR_RADII_KM
from spatiofuse.functions import cells as G
from spatiofuse.functions.scalar import haversine_km
from spatiofuse.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR_LIMIT = 1_000_000  # point pairs of one cell pair and day that rows of a join may compare
_MATRIX = 4_000_000  # place pairs compared at a time in one task
_DAYS = 32  # days whose totals one group holds
_BLOCK = 32  # neighbouring places that meet others as one where no circle cuts them
MAX_LEVELS = 12


def _tag(radius: float) -> str:
    return f"{radius:g}"


def _layout(radius_km: float) -> tuple[float, int]:
    """Cell size (degrees, at least the radius) that divides the circle evenly."""
    count = max(1, math.floor(180.0 / (radius_km / KM_PER_DEGREE)))
    return 180.0 / count, 2 * count


def _level(size: float, count: int, level: int) -> tuple[Column, Column]:
    return F.lit(size / 2**level), F.lit(count * 2**level).cast("long")


def _with_cell(df: DataFrame, size: float, count: int, level: int, names=("ci", "cj")) -> DataFrame:
    s, n = _level(size, count, level)
    return df.withColumns({names[0]: G.lat_index("lat", s), names[1]: G.lon_index("lon", s, n)})


def _reached_cells(df: DataFrame, size: float, count: int, radius: float, lat_lo, lat_hi, lon_lo, lon_hi) -> DataFrame:
    """Explode each row over the top-level cells its box can reach within ``radius``."""
    s, n = _level(size, count, 0)
    pad = F.lit(radius / KM_PER_DEGREE * (1 + G.SLACK))
    reach = G.lon_reach(F.greatest(F.abs(lat_lo), F.abs(lat_hi)), F.lit(float(radius)))
    rows = F.sequence(G.lat_index(lat_lo - pad, s), G.lat_index(lat_hi + pad, s))
    j_lo = F.floor((lon_lo - reach + F.lit(180.0)) / s).cast("long")
    j_hi = F.floor((lon_hi + reach + F.lit(180.0)) / s).cast("long")
    cols = F.sequence(j_lo, F.least(j_hi, j_lo + n - 1))
    return (df.withColumn("pi", F.explode(rows)).withColumn("_j", F.explode(cols))
            .withColumn("pj", F.pmod("_j", n)).drop("_j"))


def _sums(radii, weight: list[str], inside) -> list[Column]:
    """Conditional sums of (n, s1[, s2]) per radius; ``inside(r)`` is the membership test."""
    out = []
    for r in radii:
        for part in weight:
            if part == "s2" and r != ANCHOR_RADIUS_KM:
                continue
            out.append(F.sum(F.when(inside(r), F.col(part))).alias(f"{part}_{_tag(r)}"))
    return out


def _unit_vector(lat: str, lon: str, prefix: str) -> dict[str, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return {f"{prefix}x": F.cos(la) * F.cos(lo), f"{prefix}y": F.cos(la) * F.sin(lo), f"{prefix}z": F.sin(la)}


def _chord_sq(radius_km: float) -> float:
    return (2.0 * math.sin(min(radius_km / (2.0 * EARTH_RADIUS_KM), math.pi / 2))) ** 2


def _point_sums(pairs: DataFrame, radii, keys: list[str]) -> DataFrame:
    """Sums over point pairs; the squared chord orders like the arc and needs no trigonometry per pair."""
    dx, dy, dz = (F.col(f"q{a}") - F.col(f"p{a}") for a in "xyz")
    near = (pairs.withColumn("c2", dx * dx + dy * dy + dz * dz)
            .filter(F.col("c2") <= _chord_sq(max(radii)))
            .filter((F.col("q_lat") != F.col("lat")) | (F.col("q_lon") != F.col("lon"))))
    return near.groupBy(*keys).agg(*_sums(radii, ["n", "s1", "s2"], lambda r: F.col("c2") <= _chord_sq(r)))


def place_sums(queries: DataFrame, points: DataFrame, radii, extra: list[str], dense: bool,
               pair_limit: int) -> DataFrame:
    """Per query place (date, q_lat, q_lon) and ``extra`` key: sums over other places within each radius.

    ``queries`` holds distinct (date, q_lat, q_lon); ``points`` holds
    (date, lat, lon, extra..., n, s1, s2), one row per place and extra key.
    """
    radius = max(radii)
    size, count = _layout(radius)
    keys = ["date", "q_lat", "q_lon", *extra]
    if dense:
        return _block_sums(queries, points, radii, extra, size, count, pair_limit)
    queries = queries.withColumns(_unit_vector("q_lat", "q_lon", "q"))
    points = points.withColumns(_unit_vector("lat", "lon", "p"))
    reached = _reached_cells(queries, size, count, radius,
                             F.col("q_lat"), F.col("q_lat"), F.col("q_lon"), F.col("q_lon"))
    # both sides dealt: the planner takes the exploded queries for small, and would broadcast them or join in two tasks
    return _point_sums(reached.join(_with_cell(points, size, count, 0, ("pi", "pj")).hint("merge"), ["date", "pi", "pj"]), radii, keys)


def pool_profile(pool: DataFrame, query: DataFrame | None, value: str, radii) -> tuple[float, int]:
    """Pool mean and the largest possible point-pair count of one cell pair (one small job per table)."""
    size, count = _layout(max(radii))
    by_cell = (_with_cell(pool, size, count, 0).groupBy("date", "ci", "cj")
               .agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("n"), F.sum(value).alias("s")))
    top = by_cell.agg(F.max("rows"), F.sum("s") / F.sum("n")).first()
    most = most_q = top[0] or 0
    if query is not None:
        most_q = (_with_cell(query, size, count, 0).groupBy("date", "ci", "cj").count()
                  .agg(F.max("count")).first()[0] or 0)
    return float(top[1]) if top[1] is not None else 0.0, most * most_q


def _places(lat: pd.Series, lon: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """First row of every distinct place, and every row's place."""
    (i, _), (j, columns) = pd.factorize(lat.to_numpy(float)), pd.factorize(lon.to_numpy(float))
    at = pd.factorize(i * np.int64(len(columns)) + j)[0]
    return np.unique(at, return_index=True)[1], at


class Blocks:
    """Places (unit vectors) in blocks of ``_BLOCK`` neighbours: their order, and the centre and radius (chord) of each block."""

    def __init__(self, places: np.ndarray, xyz: np.ndarray):
        order, strip = np.argsort(places[:, 0], kind="stable"), max(1, math.isqrt(len(places) * _BLOCK))
        self.order = order[np.lexsort((places[order, 1], np.arange(len(order)) // strip))]
        self.xyz = xyz[self.order]
        self.starts = np.arange(0, len(xyz), _BLOCK)
        self.block = np.arange(len(xyz)) // _BLOCK
        self.centre = np.add.reduceat(self.xyz, self.starts) / np.bincount(self.block)[:, None]
        self.radius = np.sqrt(np.maximum.reduceat(((self.xyz - self.centre[self.block]) ** 2).sum(1), self.starts))

    def met(self, other: Blocks, i: int, chord: float) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that lie within ``chord`` of every place of ``other``'s block ``i`` (sharing no place with it), and those that must be compared."""
        apart = np.sqrt(((self.centre - other.centre[i]) ** 2).sum(1))
        near, far = apart - self.radius - other.radius[i], apart + self.radius + other.radius[i]
        whole = (far <= chord * (1 - G.SLACK)) & (near > G.SLACK)
        return whole, (near <= chord * (1 + G.SLACK)) & ~whole


def _unit(places: np.ndarray) -> np.ndarray:
    la, lo = np.radians(places).T
    return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Distinct places of pool rows, and of every row its place, date, n, s1 and s2."""
    first, at = _places(rows["lat"], rows["lon"])
    return rows[["lat", "lon"]].to_numpy(float)[first], at, rows["date"].to_numpy(), *[rows[c].to_numpy(float) for c in ("n", "s1", "s2")]


def _as_bytes(rows: pd.DataFrame) -> bytes:
    """``_arrays`` (dates as day numbers) in few bytes: a place once for all its days, s2 only where it is not the square of s1."""
    spots, at, date, *totals = _arrays(rows)
    order = np.lexsort((date, at))
    n, s1, s2 = (x[order] for x in totals)
    parts = [(np.array([len(spots), len(at)]), "<i8"), (spots, "<f8"), (np.bincount(at), "<i4"), (date[order], "<i4"), (n, "<i8"), (s1, "<f8"), (s2[n != 1], "<f8")]
    return b"".join(x.astype(kind).tobytes() for x, kind in parts)


def _from_bytes(blob: bytes) -> tuple[np.ndarray, ...]:
    """What ``_as_bytes`` packed, as ``_arrays`` gives it."""
    at = 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        at += (made := np.frombuffer(blob, kind, count, at)).nbytes
        return made

    places, rows = take("<i8", 2)
    spots = take("<f8", 2 * places).reshape(-1, 2)
    where, date, n, s1 = np.repeat(np.arange(places), take("<i4", places)), take("<i4", rows), take("<i8", rows), take("<f8", rows)
    s2 = s1 * s1
    s2[n != 1] = take("<f8", int((n != 1).sum()))
    return spots, where, date, n, s1, s2


def _packed(extra: list[str]):
    """Grouped function: the pool rows of one cell -> a row for each extra key, with all of them as bytes."""
    def run(key, p):
        p = p[np.isfinite(p["lat"]) & np.isfinite(p["lon"])]
        made = [(*key, *(k if isinstance(k, tuple) else (k,)), _as_bytes(p.iloc[rows])) for k, rows in (p.groupby(extra, dropna=False).indices.items() if extra else [((), np.arange(len(p)))]) if len(rows)]
        return pd.DataFrame(made, columns=["span", "pi", "pj", *extra, "blob"])

    return run


def _matrix_sums(radii, extra: list[str]):
    """Cogrouped function: a cell's query rows and the pool near it, as rows or as cells' ``blob`` -> sums of each query row and extra key.

    Places are compared once for all their days: memberships (0 or 1) times the days' totals, one pool cell after the other.
    """
    limits = [(r, _chord_sq(r)) for r in radii]
    parts_of = {r: ("n", "s1", "s2") if r == ANCHOR_RADIUS_KM else ("n", "s1") for r in radii}
    names = [f"{part}_{_tag(r)}" for r in radii for part in parts_of[r]]

    def add(sums: dict, asked: Blocks, at: np.ndarray, days: pd.Index, spots, where, date, *totals_of) -> None:
        """Adds one part of the pool to the sums (query place; part and day) of every radius."""
        day = days.get_indexer(date)
        pool, kept = Blocks(spots, _unit(spots)), day >= 0
        spots, where = spots[pool.order], np.argsort(pool.order)[where]
        held = np.zeros((3, len(spots), len(days)))
        for k, total in enumerate(totals_of):
            held[k, where[kept], day[kept]] = total[kept]
        spread = np.hstack(held)
        totals = np.add.reduceat(spread, pool.starts)
        for r, limit in limits:
            width, chord = len(parts_of[r]) * len(days), math.sqrt(limit)
            met = [pool.met(asked, i, chord) for i in range(len(asked.starts))]
            if any(whole.any() for whole, _ in met):
                sums[r] += (np.array([whole for whole, _ in met], float) @ totals[:, :width])[asked.block]
            for lo, (_, cut) in zip(asked.starts, met):
                near, hi = np.flatnonzero(cut[pool.block]), min(lo + _BLOCK, len(at))
                for part_of in np.split(near, np.arange(_MATRIX // _BLOCK, len(near), _MATRIX // _BLOCK)) if len(near) else []:
                    c2 = sum((asked.xyz[lo:hi, None, a] - pool.xyz[None, part_of, a]) ** 2 for a in range(3))
                    here = (at[lo:hi, None, 0] == spots[None, part_of, 0]) & (at[lo:hi, None, 1] == spots[None, part_of, 1])
                    sums[r][lo:hi] += ((c2 <= limit) & ~here).astype(float) @ spread[part_of, :width]

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        columns, packed = ["date", "q_lat", "q_lon", *extra, *names], "blob" in p
        q = q[np.isfinite(q["q_lat"]) & np.isfinite(q["q_lon"])]
        if not packed:
            p = p[np.isfinite(p["lat"]) & np.isfinite(p["lon"])]
        if q.empty or p.empty:
            return pd.DataFrame(columns=columns)
        days = pd.Index(sorted(q["date"].unique()))
        first, place = _places(q["q_lat"], q["q_lon"])
        at = q[["q_lat", "q_lon"]].to_numpy(float)[first]
        wanted = np.zeros((len(at), len(days)), bool)
        wanted[place, days.get_indexer(q["date"])] = True
        asked = Blocks(at, _unit(at))
        at, wanted = at[asked.order], wanted[asked.order]
        row, col = np.nonzero(wanted)
        out = []
        for key, rows in (p.groupby(extra, dropna=False).indices.items() if extra else [((), np.arange(len(p)))]):
            sums = {r: np.zeros((len(at), len(parts_of[r]) * len(days))) for r in radii}
            for part in ((_from_bytes(p["blob"].iat[k]) for k in rows) if packed else [_arrays(p.iloc[rows])]):
                add(sums, asked, at, days, *part)
            found = sums[max(radii)][row, col] > 0
            i, j = row[found], col[found]
            each = [sums[r][i, k * len(days) + j] for r in radii for k in range(len(parts_of[r]))]
            made = {"date": days.to_numpy()[j], "q_lat": at[i, 0], "q_lon": at[i, 1], **dict(zip(extra, key if isinstance(key, tuple) else (key,))), **dict(zip(names, each))}
            out.append(pd.DataFrame(made).astype({c: "int64" for c in names if c.startswith("n_")}))
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    return run, ", ".join(f"{c} {'bigint' if c.startswith('n_') else 'double'}" for c in names)


def _block_sums(queries, points, radii, extra, size, count, pair_limit) -> DataFrame:
    """``place_sums`` for dense cells: cells are split until none holds many places, and a query cell meets the pool cells near it.

    What is copied to the query cells is a pool cell's rows as bytes (about 20 a row, its place once for all days).
    """
    radius = max(radii)
    queries = cut_lineage(queries.select(F.unix_date("date").alias("date"), "q_lat", "q_lon"))
    points = cut_lineage(points.withColumn("date", F.unix_date("date")))
    located = queries.withColumns({"lat": F.col("q_lat"), "lon": F.col("q_lon")})
    spots = cut_lineage(located.select("lat", "lon").unionByName(points.select("lat", "lon")).distinct())
    level, most = 0, max(1, math.isqrt(pair_limit) * (10 if extra else 20))  # a group's result has a row for each extra key
    while level < MAX_LEVELS:
        s, n = _level(size, count, level)
        if (_with_cell(spots, size, count, level).groupBy("ci", "cj").count().agg(F.max("count")).first()[0] or 0) <= most:
            break
        level += 1
    s, n = size / 2**level, count * 2**level
    span = F.floor(F.col("date") / F.lit(_DAYS)).alias("span")
    q = _with_cell(located, size, count, level, ("qi", "qj")).drop("lat", "lon").withColumn("span", span)
    p = _with_cell(points, size, count, level, ("pi", "pj")).withColumn("span", span)
    box = q.select("qi", "qj").distinct()
    pairs = _reached_cells(box, s, n, radius, F.col("qi") * s - 90.0, (F.col("qi") + 1) * s - 90.0,
                           F.col("qj") * s - 180.0, (F.col("qj") + 1) * s - 180.0).distinct()
    gap = haversine_km(G.lat_centre("qi", F.lit(s)), G.lon_centre("qj", F.lit(s)), G.lat_centre("pi", F.lit(s)), G.lon_centre("pj", F.lit(s)))
    pairs = cut_lineage(pairs.filter(gap - G.half_diagonal(s, "haversine") * 2 <= radius))  # cells, not rows
    kinds = "".join(f"{c} {points.schema[c].dataType.simpleString()}, " for c in extra)
    cells = p.groupBy("span", "pi", "pj").applyInPandas(_packed(extra), f"span bigint, pi bigint, pj bigint, {kinds}blob binary")
    near = cells.join(F.broadcast(pairs), ["pi", "pj"]).drop("pi", "pj")
    run, sums = _matrix_sums(radii, extra)
    keys = ["span", "qi", "qj"]
    return (q.groupBy(*keys).cogroup(near.groupBy(*keys))
            .applyInPandas(run, f"date int, q_lat double, q_lon double, {kinds}{sums}")
            .withColumn("date", F.date_from_unix_date("date")))


def pool_points(pool: DataFrame, value: str, centre: Column, extra: list[str]) -> DataFrame:
    """Distinct pool places with additive totals of the centred value."""
    v = F.col(value) - centre
    return (pool.filter(F.col(value).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
            .groupBy("date", "lat", "lon", *extra)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2")))


def day_totals(pool: DataFrame, value: str, extra: list[str] | None = None) -> DataFrame:
    """Per-day count and sum of the pool values."""
    return pool.groupBy("date", *(extra or [])).agg(
        F.count(value).alias("day_n"), F.sum(value).alias("day_sum"))


def _assemble(df: DataFrame, value: str, radii, centre: Column, strict: bool) -> DataFrame:
    """Turn totals into means, counts, spread and the fallback chain.

    Expects per-radius totals of other places, ``at_*`` totals of the row's own
    place, ``own_value`` and ``own_km`` (the pool reading of the row's own sensor
    and how far it lies; NULL without one), ``day_*`` and ``grand``.
    """
    held = F.col("own_value").isNotNull()
    own_v = F.col("own_value") - centre

    def rest_of(part: str, tag: str, mine: Column, own: Column) -> Column:
        """Sum without the own reading; a reading alone at its place cancels exactly."""
        here = mine & (F.col("own_km") == 0)
        place = F.coalesce(F.col(f"at_{part}"), F.lit(0.0)) - F.when(here, own).otherwise(0.0)
        return F.coalesce(F.col(f"{part}_{tag}"), F.lit(0.0)) - F.when(mine & ~here, own).otherwise(0.0) + place

    out = {}
    for r in radii:
        t = _tag(r)
        mine = F.coalesce(held & (F.col("own_km") <= r), F.lit(False))
        n = F.coalesce(F.col(f"n_{t}"), F.lit(0)) + F.coalesce(F.col("at_n"), F.lit(0)) - mine.cast("long")
        s1 = rest_of("s1", t, mine, own_v)
        out[f"_n_{t}"], out[f"_m_{t}"] = n, F.when(n > 0, centre + s1 / n)
        if r == ANCHOR_RADIUS_KM:
            s2 = rest_of("s2", t, mine, own_v * own_v)
            out["_std"] = F.when(n > 1, F.sqrt(F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0)))).otherwise(0.0)
    df = df.withColumns(out)
    taken = F.coalesce(F.col("own_value"), F.lit(0.0)) if strict else F.col(value)
    left = F.greatest(F.col("day_n") - (held.cast("long") if strict else F.lit(1)), F.lit(1))
    day_mean = F.when(F.col(value).isNotNull(), (F.col("day_sum") - taken) / left)
    anchor = F.coalesce(F.col(f"_m_{_tag(ANCHOR_RADIUS_KM)}"), day_mean, F.col("grand"))
    final = {}
    for r in radii:
        t = _tag(r)
        final[f"nbr_pm25_{t}km"] = anchor if r == ANCHOR_RADIUS_KM else F.coalesce(F.col(f"_m_{t}"), anchor)
        final[f"nbr_count_{t}km"] = F.col(f"_n_{t}").cast("int")
    final[f"nbr_std_{_tag(ANCHOR_RADIUS_KM)}km"] = F.col("_std")
    return df.withColumns(final)


def with_neighbor_features(query: DataFrame, pool: DataFrame | None = None, value: str | None = None,
                           radii=NEIGHBOR_RADII_KM, pair_limit: int = PAIR_LIMIT, strict: bool = True) -> DataFrame:
    """Add the neighbour columns to ``query`` (needs sensor_id, date, lat, lon).

    ``pool`` defaults to the query itself; one reading per (sensor, date) is the
    contract. A query row never counts a pool row of its own sensor id (compared
    as text), wherever that row lies. Rows without a neighbour fall back to the same-day mean of the
    others, then to the pool mean; a query without the value column (an
    arbitrary site) goes straight to the pool mean. ``strict`` takes the own pool
    reading, if there is one, out of the day mean; ``strict=False`` always takes the
    query row's value out, for parity with pipelines that do.
    """
    shared = pool is None
    pool = query if shared else pool
    value = value or ("target" if "target" in pool.columns else "pm25")
    has_value = value in query.columns
    if not has_value:
        query = query.withColumn(value, F.lit(None).cast("double"))
    mean, pairs = pool_profile(pool, None if shared else query, value, radii)
    pool = pool.filter(F.col(value).isNotNull())
    grand = F.lit(mean)
    points = pool_points(pool, value, grand, [])
    places = (query.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
              .select("date", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")).distinct())
    sums = place_sums(places, points, radii, [], pairs > pair_limit, pair_limit)
    at_place = points.select("date", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"),
                             F.col("n").alias("at_n"), F.col("s1").alias("at_s1"), F.col("s2").alias("at_s2"))
    by_place = at_place.join(sums, ["date", "q_lat", "q_lon"], "full")
    keyed = query.withColumns({"q_lat": F.col("lat"), "q_lon": F.col("lon")})
    if shared:
        keyed = keyed.withColumns({"own_value": F.col(value), "own_km": F.lit(0.0)})
    else:
        mine = pool.select("date", F.col("sensor_id").cast("string").alias("_sid"),
                           F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col(value).alias("own_value"))
        same = (F.col("_lat") == F.col("q_lat")) & (F.col("_lon") == F.col("q_lon"))
        away = haversine_km("q_lat", "q_lon", "_lat", "_lon")
        keyed = (keyed.withColumn("_sid", F.col("sensor_id").cast("string")).join(mine, ["date", "_sid"], "left")
                 .withColumn("own_km", F.when(same, 0.0).otherwise(away)).drop("_sid", "_lat", "_lon"))
    joined = (keyed.join(by_place, ["date", "q_lat", "q_lon"], "left")
              .join(F.broadcast(day_totals(pool, value)), "date", "left")  # one row per calendar day
              .withColumn("grand", grand))
    out = _assemble(joined, value, radii, grand, strict)
    kept = [c for c in query.columns if c not in NEIGHBOR_COLUMNS and (has_value or c != value)]
    return out.select(*kept, *NEIGHBOR_COLUMNS)


def neighbor_features_per_fold(frame: DataFrame, value: str = "target", n_folds: int | None = None,
                               radii=NEIGHBOR_RADII_KM, strict: bool = True,
                               pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Neighbour columns of every row against each fold's training pool.

    Returns ``(fold_out, sensor_id, date, nbr_*)``: for each held-out fold the
    pool is the rows of the other folds. The range join runs once, carrying the
    pool row's fold; the totals of the folds that stay are then added up.
    ``strict`` removes a row's own reading from its day mean only when that
    reading is in the pool (no leak of a held-out value); ``strict=False`` always
    removes it, for parity with pipelines that do.
    """
    frame = cut_lineage(frame.select("sensor_id", "date", "lat", "lon", "fold", value))  # read by several steps
    mean, pairs = pool_profile(frame, None, value, radii)
    pool = frame.filter(F.col(value).isNotNull())
    grand = F.lit(mean)
    points = pool_points(pool, value, grand, ["fold"])
    places = (frame.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
              .select("date", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")).distinct())
    sums = place_sums(places, points, radii, ["fold"], pairs > pair_limit, pair_limit)
    at_place = points.select("date", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), "fold",
                             F.col("n").alias("at_n"), F.col("s1").alias("at_s1"), F.col("s2").alias("at_s2"))
    folds = frame.select("fold").distinct().agg(F.sort_array(F.collect_set("fold"))).scalar()  # one value per fold

    def others(df):
        return (df.withColumn("fold_out", F.explode(folds)).filter(F.col("fold_out") != F.col("fold")))

    place = ["date", "q_lat", "q_lon"]

    def held(df, name):
        """One row for a place and day with the totals of its folds, dealt and joined once."""
        return df.groupBy(*place).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in place])).alias(name))

    def kept(df, name, fold_out: Column) -> Column:
        """Sums of the folds that stay."""
        parts = [f for f in df.schema.fields if f.name not in (*place, "fold")]
        none = F.struct(*[F.lit(0).cast(f.dataType).alias(f.name) for f in parts])
        return F.aggregate(F.filter(name, lambda x: x["fold"] != fold_out), none, lambda a, x: F.struct(
            *[(a[f.name] + F.coalesce(x[f.name], F.lit(0).cast(f.dataType))).alias(f.name) for f in parts])).alias(name)

    days = (others(day_totals(pool, value, ["fold"])).groupBy("date", "fold_out")
            .agg(F.sum("day_n").alias("day_n"), F.sum("day_sum").alias("day_sum")))
    grands = (others(pool.groupBy("fold").agg(F.sum(value).alias("gs"), F.count(value).alias("gn")))
              .groupBy("fold_out").agg((F.sum("gs") / F.sum("gn")).alias("grand")))
    rows = frame.select("sensor_id", "date", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), "fold", value)
    found = rows.join(held(at_place, "at"), place, "left").join(held(sums, "near"), place, "left").withColumn("folds", folds)
    each = F.transform("folds", lambda f: F.struct(f.alias("fold_out"), kept(at_place, "at", f), kept(sums, "near", f)))
    joined = (found.select(*rows.columns, F.inline(each)).select(*rows.columns, "fold_out", "at.*", "near.*")
              .join(F.broadcast(days), ["date", "fold_out"], "left").join(F.broadcast(grands), "fold_out", "left")  # one row per fold
              .withColumns({"own_value": F.when(F.col("fold") != F.col("fold_out"), F.col(value)), "own_km": F.lit(0.0)})
              .withColumn("grand", F.coalesce("grand", F.lit(0.0))))
    out = _assemble(joined, value, radii, grand, strict=strict)
    return out.select("fold_out", "sensor_id", "date", *NEIGHBOR_COLUMNS)
