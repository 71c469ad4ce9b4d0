"""Lat/lon cells and rigorous distance bounds between them.

Cells turn every spatial join into an equi-join. A cell's centre plus its
half-diagonal bounds the distance to any point inside it, on the sphere or in
the degree plane, so filters on cells never lose a pair. Longitude wraps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from spatiofuse.constants import EARTH_RADIUS_KM, KM_PER_DEGREE
from spatiofuse.functions.scalar import col_of, degree_distance, haversine_km

SLACK = 1e-9  # relative slack so that rounding never drops a pair on a bound


def lat_index(lat, size) -> Column:
    return F.floor((col_of(lat) + F.lit(90.0)) / size).cast("long")


def lon_index(lon, size, count) -> Column:
    """Wrapped index: ``count`` cells of ``size`` degrees go once around."""
    return F.pmod(F.floor((col_of(lon) + F.lit(180.0)) / size).cast("long"), count)


def lat_centre(i, size) -> Column:
    return (col_of(i) + F.lit(0.5)) * size - F.lit(90.0)


def lon_centre(j, size) -> Column:
    return (col_of(j) + F.lit(0.5)) * size - F.lit(180.0)


def half_diagonal(size, metric: str) -> Column:
    """Largest distance from a cell's centre to a point of the cell."""
    size = size if isinstance(size, Column) else F.lit(float(size))
    scale = KM_PER_DEGREE if metric == "haversine" else 1.0
    return size * F.lit(scale * (1 + SLACK) / math.sqrt(2.0))


def distance(metric: str):
    if metric not in ("haversine", "degree"):
        raise ValueError(f"unknown metric {metric!r}")
    return haversine_km if metric == "haversine" else degree_distance


def lon_reach(max_abs_lat: Column, km: Column) -> Column:
    """Largest longitude difference (degrees) within ``km`` of that latitude."""
    arc = km / F.lit(EARTH_RADIUS_KM)
    lat = F.radians(max_abs_lat)
    polar = (lat + arc >= F.lit(math.pi / 2))
    ratio = F.least(F.sin(F.least(arc, F.lit(math.pi / 2))) / F.cos(lat), F.lit(1.0))
    return F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)) * F.lit(1 + SLACK) + F.lit(SLACK))
