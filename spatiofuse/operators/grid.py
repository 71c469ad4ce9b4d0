"""Regular grid, long-form channel stack, fills, flags, normalisation and supervision."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spatiofuse import constants as C
from spatiofuse.functions import scalar as S
from spatiofuse.operators.nearest import interpolate, nearest


@dataclass(frozen=True)
class Grid:
    """Ascending axes as whole multiples of ``step`` degrees."""

    i_lo: int
    j_lo: int
    height: int
    width: int
    step: float

    @property
    def lat0(self) -> float:
        return round(self.i_lo * self.step, 6)

    @property
    def lon0(self) -> float:
        return round(self.j_lo * self.step, 6)

    def lat(self, row="row") -> Column:
        return F.round((F.lit(self.i_lo) + F.col(row)) * F.lit(self.step), 6)

    def lon(self, col="col") -> Column:
        return F.round((F.lit(self.j_lo) + F.col(col)) * F.lit(self.step), 6)

    def pixel(self, lat="lat", lon="lon") -> dict[str, Column]:
        return S.pixel_index(lat, lon, self.lat0, self.lon0, self.step, self.height, self.width)


def grid_over(extent: DataFrame, step: float = C.GRID_DEG, pad: int = 1) -> Grid:
    """Grid covering the extent of (lat, lon), snapped outward and padded (one min/max row is read)."""
    r = extent.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    i_lo, i_hi = math.floor(r[0] / step - pad), math.ceil(r[1] / step + pad)
    j_lo, j_hi = math.floor(r[2] / step - pad), math.ceil(r[3] / step + pad)
    return Grid(i_lo, j_lo, i_hi - i_lo + 1, j_hi - j_lo + 1, step)


def grid_points(spark: SparkSession, grid: Grid) -> DataFrame:
    """Row-major grid nodes: (row, col, lat, lon)."""
    ids = spark.range(grid.height * grid.width)
    return (ids.select(F.floor(F.col("id") / grid.width).cast("long").alias("row"), (F.col("id") % grid.width).alias("col"))
            .withColumns({"lat": grid.lat(), "lon": grid.lon()}))


def grid_days(dates: DataFrame, grid: Grid) -> DataFrame:
    """Every grid node on every date, built by expanding the dates (no join)."""
    rows = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.height - 1).cast("long")))
    cols = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.width - 1).cast("long")))
    return (dates.select("date").distinct().withColumn("row", rows).repartition("date", "row")
            .withColumn("col", cols).withColumns({"lat": grid.lat(), "lon": grid.lon()}))


def unpivoted(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Long (keys, channel, value) rows, NULLs kept."""
    entries = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(entries).alias("_e")).select(*keys, F.col("_e.channel"), F.col("_e.value"))


def _probes(valid: DataFrame, grid: Grid) -> DataFrame:
    """Grid nodes for every (date, channel) that has a value."""
    present = valid.select("date", "channel").distinct()
    return grid_days(valid, grid).join(present, "date").select("date", "channel", "row", "col", "lat", "lon")


def gridded(product: DataFrame, columns: list[str], grid: Grid, k: int = 1, lat: str = "lat", lon: str = "lon",
            id_col: str | None = None, power_floor: float = 1e-6) -> DataFrame:
    """Per day and channel: IDW of the k nearest *valid* points (k=1: nearest valid cell).

    Returns (date, row, col, channel, value); a channel without a value that day has no rows.
    """
    ids = [F.col(id_col).alias("id")] if id_col else [F.struct(lat, lon).alias("id")]
    keyed = product.select("date", F.col(lat).alias("lat"), F.col(lon).alias("lon"), *ids,
                           *[c for c in columns if c not in (lat, lon)])
    valid = unpivoted(keyed, ["date", "lat", "lon", "id"], columns).filter("value IS NOT NULL")
    probes = _probes(valid, grid)
    found = interpolate(probes.select("date", "channel", "lat", "lon"), valid, ["value"], k=k, floor=power_floor,
                        on=("date", "channel"), metric="degree")
    return probes.join(found, ["date", "channel", "lat", "lon"]).select("date", "row", "col", "channel", "value")


def static_plane(points: DataFrame, value: str, grid: Grid, spark: SparkSession, k: int = 4) -> DataFrame:
    """(row, col, value): IDW plane of scattered static values (e.g. tract elevations)."""
    nodes = grid_points(spark, grid)
    pool = points.filter(F.col(value).isNotNull()).select("lat", "lon", F.col("GEOID").alias("id"), F.col(value).alias("value"))
    found = interpolate(nodes.select("lat", "lon"), pool, ["value"], k=k, floor=1e-6, on=(), metric="degree")
    return nodes.join(found, ["lat", "lon"]).select("row", "col", "value")


def over_days(plane: DataFrame, dates: DataFrame, grid: Grid, channel: str) -> DataFrame:
    """A static plane repeated on every date."""
    return (grid_days(dates, grid).join(plane, ["row", "col"])
            .select("date", "row", "col", F.lit(channel).alias("channel"), "value"))


def smoke_plane(sensors: DataFrame, smoke: DataFrame, dates: DataFrame, grid: Grid, spark: SparkSession) -> DataFrame:
    """Tier of the nearest sensor site; a sensor without a smoke row counts as 0.

    All sensors are candidates every day, so the nearest site of a node is found
    once and the day's tiers are joined to it.
    """
    nodes = grid_points(spark, grid)
    found = nearest(nodes.select("lat", "lon"), sensors.select("lat", "lon", F.col("sensor_id").alias("id")), 1,
                    on=(), metric="degree")
    mapped = nodes.join(found.select("lat", "lon", F.col("p_id").alias("sensor_id")), ["lat", "lon"])
    days = grid_days(dates, grid).join(mapped.select("row", "col", "sensor_id"), ["row", "col"])
    tiers = smoke.select("sensor_id", "date", F.col("hms_smoke").cast("double").alias("_t")).dropDuplicates(["sensor_id", "date"])
    return (days.join(tiers, ["sensor_id", "date"], "left")
            .select("date", "row", "col", F.lit("hms_smoke").alias("channel"), F.coalesce("_t", F.lit(0.0)).alias("value")))


def calendar_planes(dates: DataFrame, grid: Grid, with_dow: bool = False) -> DataFrame:
    """Day-of-year planes (365.25-day year), optionally day-of-week planes."""
    parts = dict(zip(("doy_sin", "doy_cos"), S.cyclic(F.dayofyear("date"), C.GRID_DOY_PERIOD)))
    if with_dow:
        parts |= dict(zip(("dow_sin", "dow_cos"), S.cyclic(F.weekday("date"), 7.0)))
    return unpivoted(grid_days(dates, grid).withColumns(parts), ["date", "row", "col"], list(parts))


def channel_stack(parts: dict[str, DataFrame], channels: dict[str, list[str]], dates: DataFrame, grid: Grid) -> DataFrame:
    """Complete lattice (date, row, col, group, channel, value) of the grouped channel rows; gaps are NULL."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.withColumn("group", F.lit(g)) for g, df in parts.items()])
    names = [F.struct(F.lit(g).alias("group"), F.lit(c).alias("channel")) for g, cs in channels.items() for c in cs]
    lattice = (grid_days(dates, grid).withColumn("_c", F.explode(F.array(*names)))
               .select("date", "row", "col", F.col("_c.group").alias("group"), F.col("_c.channel").alias("channel")))
    return lattice.join(rows, ["date", "row", "col", "group", "channel"], "left")


def base_stack(panel: DataFrame, cells: DataFrame, smoke: DataFrame, tract_elevation: DataFrame, grid: Grid,
               spark: SparkSession, extended: bool = False, forecast: DataFrame | None = None,
               reanalysis: DataFrame | None = None) -> DataFrame:
    """Five source groups on the grid; ``extended`` adds dust, day-of-week and the optional products.

    ``cells`` carries cell_lat, cell_lon, date and both aerosol and extra columns;
    the flag group is appended by ``with_flags``.
    """
    dates = panel.select("date").distinct()
    sensors = panel.groupBy("sensor_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    channels = {g: list(c) for g, c in C.GROUP_CHANNELS.items()}
    if extended:
        channels["aerosol"].append("dust")
        channels["temporal"] += ["dow_sin", "dow_cos"]
    met = gridded(panel, C.MET_COLUMNS, grid, k=8, id_col="sensor_id")
    extra = gridded(cells, C.MET_EXTRA_COLUMNS, grid, lat="cell_lat", lon="cell_lon")
    parts = {
        "aerosol": gridded(cells, channels["aerosol"], grid, lat="cell_lat", lon="cell_lon"),
        "smoke": smoke_plane(sensors, smoke, dates, grid, spark),
        "meteorology": met.unionByName(extra),
        "static": over_days(static_plane(tract_elevation, "elevation", grid, spark), dates, grid, "elevation"),
        "temporal": calendar_planes(dates, grid, with_dow=extended),
    }
    for name, product, columns in (("ctm", forecast, C.FORECAST_FEATURES),
                                   ("merra2", reanalysis, C.REANALYSIS_FEATURES[:5] + ["merra2_pblh"])):
        if product is not None:
            channels[name] = columns
            inside = product.join(dates, "date", "left_semi")
            parts[name] = gridded(inside, [c for c in columns if c in product.columns], grid)
    return channel_stack(parts, channels, dates, grid)


def group_flags(stack: DataFrame) -> DataFrame:
    """(date, group, flag): 1.0 when the group has any value that day, before filling."""
    return stack.groupBy("date", "group").agg(F.max(F.col("value").isNotNull().cast("double")).alias("flag"))


def with_flags(stack: DataFrame, grid: Grid) -> DataFrame:
    flags = group_flags(stack).select("date", F.concat(F.lit("flag_"), "group").alias("channel"), F.col("flag").alias("value"))
    planes = (grid_days(stack, grid).join(flags, "date")
              .select("date", "row", "col", F.lit("flags").alias("group"), "channel", "value"))
    return stack.unionByName(planes)


def fill_values(stack: DataFrame) -> DataFrame:
    """(group, channel, fill): mean of the values, 0.0 when there is none."""
    return stack.groupBy("group", "channel").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("fill"))


def filled(stack: DataFrame, fills: DataFrame | None = None) -> DataFrame:
    """Replace NULLs by the channel fill; pass stored fills to reuse them."""
    fills = fill_values(stack) if fills is None else fills
    return (stack.join(F.broadcast(fills), ["group", "channel"], "left")  # one row per channel
            .withColumn("value", F.coalesce("value", "fill")).drop("fill"))


def channel_stats(stack: DataFrame, observed_only: bool = False) -> DataFrame:
    """(group, channel, mean, std) with population std floored at 1e-6.

    ``observed_only`` is the pre-fill variant: NULLs are skipped, a channel
    without values gives (0, 1) and the flag group keeps its units.
    """
    stats = stack.groupBy("group", "channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    floor = F.greatest(F.col("std"), F.lit(1e-6))
    if not observed_only:
        return stats.withColumn("std", floor)
    plain = (F.col("group") == "flags") | F.col("mean").isNull()
    return stats.select("group", "channel", F.when(plain, 0.0).otherwise(F.col("mean")).alias("mean"),
                        F.when(plain, 1.0).otherwise(floor).alias("std"))


def standardised(stack: DataFrame, stats: DataFrame) -> DataFrame:
    return (stack.join(F.broadcast(stats), ["group", "channel"])  # one row per channel
            .withColumn("value", (F.col("value") - F.col("mean")) / F.col("std")).drop("mean", "std"))


# Supervision -------------------------------------------------------------

def supervision(panel: DataFrame, grid: Grid, region: DataFrame | None = None) -> DataFrame:
    """In-region readings snapped to pixels: (date, row, col, pixel, pm25, sensor_id)."""
    rows = panel.filter("pm25 IS NOT NULL")
    if region is not None:
        rows = rows.join(region, "sensor_id", "left_semi")
    return (rows.withColumns(grid.pixel()).filter("pixel IS NOT NULL")
            .select("date", "row", "col", "pixel", "pm25", "sensor_id"))


def corrected_supervision(obs: DataFrame, panel: DataFrame, method: str = "corrected") -> DataFrame:
    """Rewrite readings by the target rule; rows without humidity are dropped.

    The right side is reduced to one row per (sensor, date), so the join keeps
    the row count.
    """
    if method == "raw":
        return obs
    if method != "corrected":
        raise ValueError(f"unknown correction method {method!r}; use 'corrected' or 'raw'")
    right = (panel.groupBy("sensor_id", "date")
             .agg(F.min_by("pm25", F.coalesce("humidity", F.lit(1e9))).alias("_pm"), F.min("humidity").alias("_rh")))
    joined = obs.join(right, ["sensor_id", "date"], "left")
    return (joined.withColumn("pm25", S.humidity_corrected("_pm", "_rh")).filter("pm25 IS NOT NULL")
            .select(*obs.columns))


def pixel_targets(obs: DataFrame) -> DataFrame:
    """Mean reading per pixel-day; a row's existence is the mask."""
    return obs.groupBy("date", "row", "col").agg(F.avg("pm25").alias("y"), F.count(F.lit(1)).alias("n"))


def sampled_surface(rows: DataFrame, surface: DataFrame, grid: Grid, value: str = "pm25") -> DataFrame:
    """Surface value at each row's pixel and day; NULL off the grid or window."""
    located = rows.withColumns(grid.pixel())
    return (located.join(surface.select("date", "row", "col", F.col(value).alias("surface")), ["date", "row", "col"], "left"))


def day_selection(stack: DataFrame) -> DataFrame:
    """The smokiest day and the cleanest other day: (role, date, smoke, cams).

    Smoky ties go to the higher grid-mean prior, clean ties to the lower.
    """
    def mean_of(channel):
        return F.coalesce(F.avg(F.when(F.col("channel") == channel, F.col("value"))), F.lit(0.0))

    days = stack.groupBy("date").agg(mean_of("hms_smoke").alias("smoke"), mean_of("cams_pm25").alias("cams"))
    smoky = days.orderBy(F.desc("smoke"), F.desc("cams"), "date").limit(1).withColumn("role", F.lit("smoke"))
    clean = (days.join(smoky.select("date"), "date", "left_anti").orderBy("smoke", "cams", "date").limit(1)
             .withColumn("role", F.lit("clean")))
    return smoky.unionByName(clean).select("role", "date", "smoke", "cams")
