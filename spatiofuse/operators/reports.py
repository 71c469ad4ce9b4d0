"""Inventory and report aggregates: coverage windows, histograms, bins, hulls, selections."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatiofuse.functions import scalar as S
from spatiofuse.functions.ordering import sampled
from spatiofuse.functions.quantiles import exact_quantiles

# Grouped functions travel to the executors by value: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sensor_inventory(panel: DataFrame, key: str = "sensor_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Median coordinates and record count per sensor (or site).

    A sensor has few distinct coordinates, and ``median`` merges value counts, so
    the buffer stays small however many rows a sensor has.
    """
    return panel.groupBy(key).agg(F.median(lat).alias("lat"), F.median(lon).alias("lon"), F.count(F.lit(1)).alias("n"))


def active_by_month(panel: DataFrame) -> DataFrame:
    return (panel.groupBy(F.trunc("date", "MM").alias("month"))
            .agg(F.count_distinct("sensor_id").alias("active")))


def activity_summary(monthly: DataFrame) -> DataFrame:
    """First, last and peak of the monthly counts (one row per month in)."""
    return monthly.agg(F.min_by("active", "month").alias("first_n"), F.max_by("active", "month").alias("last_n"),
                       F.max("active").alias("peak_n"))


def coverage_windows(sources: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
             .select(F.lit(name).alias("source"), "first_date", "last_date") for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def correction_by_humidity(panel: DataFrame, width: float = 2.5, bins: int = 40, min_rows: int = 30) -> DataFrame:
    """Mean and quartiles of (corrected − raw) per humidity bin with enough rows."""
    delta = (panel.filter("pm25 IS NOT NULL AND humidity IS NOT NULL")
             .select(S.fixed_bin("humidity", width, bins).alias("bin"),
                     (S.humidity_corrected("pm25", "humidity") - F.col("pm25")).alias("delta")).filter("bin IS NOT NULL"))
    means = delta.groupBy("bin").agg(F.avg("delta").alias("mean"))
    quartiles = exact_quantiles(delta, "delta", {"q25": 0.25, "q75": 0.75}, ["bin"]).filter(F.col("n") >= min_rows)
    return (quartiles.join(means, "bin")
            .select("bin", ((F.col("bin") + 0.5) * F.lit(width)).alias("centre"), "n", "mean", "q25", "q75"))


def correction_hexbins(panel: DataFrame, gridsize: int = 55, sample: int | None = None, seed=7) -> DataFrame:
    """Hexagon counts of raw vs corrected readings on (0, P99.9)²; points beyond it are left out."""
    df = panel.filter("pm25 IS NOT NULL AND humidity IS NOT NULL").select(
        "sensor_id", "date", "pm25", S.humidity_corrected("pm25", "humidity").alias("corrected"))
    if sample is not None:
        df = sampled(df, sample, seed, ["sensor_id", "date"])
    hi = exact_quantiles(df, "pm25", {"hi": 0.999}).select("hi").scalar()
    inside = df.withColumn("_hi", hi).filter((F.col("pm25") <= F.col("_hi")) & (F.col("corrected") <= F.col("_hi")))
    return (inside.withColumns(S.hex_bin("pm25", "corrected", F.col("_hi"), gridsize))
            .groupBy("lattice", "hx", "hy").agg(F.count(F.lit(1)).alias("n")))


def daily_means(oof: DataFrame, columns: list[str]) -> DataFrame:
    return oof.groupBy("date").agg(*[F.avg(c).alias(c) for c in columns])


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Equal-width counts over [min, max]; the last bin holds the maximum. Empty bins are absent."""
    v = df.filter(F.col(value).isNotNull())
    ends = v.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    placed = v.select(F.col(value).alias("v"), ends.alias("e"))
    width = (F.col("e.hi") - F.col("e.lo")) / F.lit(float(bins))
    index = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("e.lo")) / width), F.lit(bins - 1))).otherwise(0)
    return (placed.select(index.cast("int").alias("bin"), "e").groupBy("bin")
            .agg(F.min("e.lo").alias("lo"), F.min((F.col("e.hi") - F.col("e.lo")) / F.lit(float(bins))).alias("width"),
                 F.count(F.lit(1)).alias("n"))
            .select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left"), "n"))


def axis_limits(df: DataFrame, columns: list[str], p: float = 0.995) -> DataFrame:
    """High quantile over the pooled values of several columns, NULLs ignored."""
    pooled = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v"))
    return exact_quantiles(pooled, "v", {"limit": p})


def busiest_sensor_month(panel: DataFrame) -> DataFrame:
    """Rows of the (sensor, month) with most readings; ties go to the smallest key."""
    keyed = panel.withColumn("month", F.trunc("date", "MM"))
    top = (keyed.groupBy("sensor_id", "month").agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), "sensor_id", "month").limit(1))
    return keyed.join(top, ["sensor_id", "month"], "left_semi")


def block_map(frame: DataFrame, blocks: DataFrame) -> DataFrame:
    """First coordinates and block of each sensor."""
    first = frame.groupBy("sensor_id").agg(
        F.min_by("lat", "date").alias("lat"), F.min_by("lon", "date").alias("lon"))
    return first.join(blocks.select("sensor_id", "block"), "sensor_id")


def block_counts(mapped: DataFrame) -> DataFrame:
    """Sensors per block and whether it is the largest."""
    sizes = mapped.groupBy("block").agg(F.count(F.lit(1)).alias("n_sensors"))
    rank = F.row_number().over(W.orderBy(F.desc("n_sensors"), "block"))  # one row per block
    return sizes.withColumn("is_largest", rank == 1)


def hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise convex hull of (x, y) points, from the lowest leftmost one.

    Gift wrapping: from each vertex the next is the point with the least turn from
    the last edge's direction, the farthest of those in line.
    """
    distinct = np.unique(points, axis=0)
    if len(distinct) < 3:
        return distinct
    here, heading, found = distinct[0], np.array([0.0, -1.0]), []
    while not found or (here != found[0]).any():
        found.append(here)
        step = distinct - here
        length = np.hypot(step[:, 0], step[:, 1])
        turn = np.arctan2(heading[0] * step[:, 1] - heading[1] * step[:, 0], step @ heading) % (2 * np.pi)
        turn = np.where((length == 0) | (turn > 2 * np.pi - 1e-12), np.inf, turn)
        in_line = turn <= turn.min() + 1e-12
        follow = distinct[int(np.where(in_line, length, -1.0).argmax())]
        here, heading = follow, (follow - here) / np.hypot(*(follow - here))
        if len(found) > len(distinct):
            break
    return np.array(found)


def block_hulls(mapped: DataFrame, pad: float = 0.10) -> DataFrame:
    """Padded convex hull per block: (block, vertex, lon, lat).

    A partial hull per slice of a block is taken first (a hull vertex of the block
    is a hull vertex of its slice), so the final group only sees slice vertices.
    """
    def slice_hull(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["lon", "lat"]].to_numpy(float))
        return pd.DataFrame({"block": int(pdf["block"].iloc[0]), "lon": h[:, 0], "lat": h[:, 1]})

    def final_hull(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["lon", "lat"]].to_numpy(float))
        c = h.mean(axis=0)
        h = c + (h - c) * (1.0 + pad)
        return pd.DataFrame({"block": int(pdf["block"].iloc[0]), "vertex": np.arange(len(h)), "lon": h[:, 0], "lat": h[:, 1]})

    sliced = mapped.select(F.col("block").cast("int"), "lon", "lat", F.pmod(F.xxhash64("sensor_id"), F.lit(1024)).alias("_s"))
    parts = sliced.groupBy("block", "_s").applyInPandas(slice_hull, "block int, lon double, lat double")
    return parts.groupBy("block").applyInPandas(final_hull, "block int, vertex int, lon double, lat double")
