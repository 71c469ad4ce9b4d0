"""Row-level expressions. Missing values are NULL everywhere (NaN is converted on ingest)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiofuse import constants as C


def col_of(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_not_finite(x) -> Column:
    x = col_of(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def finite_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn NaN and infinities into NULL for the named columns that exist."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: null_if_not_finite(c) for c in present})


def clip_low(x, low: float = 0.0) -> Column:
    """``max(x, low)`` that keeps NULL (``greatest`` alone would skip it)."""
    x = col_of(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def humidity_corrected(pm, rh) -> Column:
    raw = (F.lit(C.CORRECTION_SLOPE) * col_of(pm) + F.lit(C.CORRECTION_RH_COEF) * col_of(rh)
           + F.lit(C.CORRECTION_INTERCEPT))
    return clip_low(raw)


def with_target(df: DataFrame, method: str = "corrected") -> DataFrame:
    """Add ``target``: the humidity-corrected reading, or the raw one."""
    if method == "corrected":
        return df.withColumn("target", humidity_corrected("pm25", "humidity"))
    if method == "raw":
        return df.withColumn("target", F.col("pm25").cast("double"))
    raise ValueError(f"unknown correction method {method!r}; use 'corrected' or 'raw'")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a_lat, a_lon = F.radians(col_of(lat1)), F.radians(col_of(lon1))
    b_lat, b_lon = F.radians(col_of(lat2)), F.radians(col_of(lon2))
    s_lat = F.sin((b_lat - a_lat) / F.lit(2.0))
    s_lon = F.sin((b_lon - a_lon) / F.lit(2.0))
    h = s_lat * s_lat + F.cos(a_lat) * F.cos(b_lat) * s_lon * s_lon
    h = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return F.lit(2.0 * C.EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def degree_distance(lat1, lon1, lat2, lon2) -> Column:
    dy = col_of(lat2) - col_of(lat1)
    dx = col_of(lon2) - col_of(lon1)
    return F.sqrt(dy * dy + dx * dx)


def distance_to_points(lat, lon, points=None) -> Column:
    """Distance in km to the closest of a short fixed list of points."""
    points = C.COAST_POINTS if points is None else points
    terms = [haversine_km(lat, lon, F.lit(p[0]), F.lit(p[1])) for p in points]
    return terms[0] if len(terms) == 1 else F.least(*terms)


def cyclic(x, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * col_of(x) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def with_calendar(df: DataFrame) -> DataFrame:
    """Calendar fields and their cyclic encodings; columns already present are kept."""
    def add(frame, exprs):
        return frame.withColumns({k: v for k, v in exprs.items() if k not in frame.columns})

    df = add(df, {
        "month": F.month("date"),
        "dow": F.weekday("date"),
        "day_of_year": F.dayofyear("date"),
    })
    pairs = {}
    for name, source, period in (("month", "month", 12.0), ("dow", "dow", 7.0),
                                 ("doy", "day_of_year", C.FRAME_DOY_PERIOD)):
        pairs[f"{name}_sin"], pairs[f"{name}_cos"] = cyclic(source, period)
    return add(df, pairs)


def with_interactions(df: DataFrame) -> DataFrame:
    exprs = {}
    if "temp_x_humidity" not in df.columns and {"temperature", "humidity"} <= set(df.columns):
        exprs["temp_x_humidity"] = F.col("temperature") * F.col("humidity") / F.lit(100.0)
    if "wind_x_temp" not in df.columns and {"wind_speed", "temperature"} <= set(df.columns):
        exprs["wind_x_temp"] = F.col("wind_speed") * F.col("temperature") / F.lit(100.0)
    return df.withColumns(exprs) if exprs else df


def with_missing_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Guarantee that every name exists, as a NULL double where it was absent."""
    absent = {c: F.lit(None).cast("double") for c in names if c not in df.columns}
    return df.withColumns(absent) if absent else df


def first_present(df: DataFrame, candidates: list[str]) -> str:
    """First candidate that is a column of ``df``; an error names what exists."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates} in {sorted(df.columns)}")


def zero_padded(x, width: int) -> Column:
    """Left-pad to ``width``; longer text is kept whole (``lpad`` alone would cut it)."""
    x = col_of(x).cast("string")
    return F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)


def duration_rank(x) -> Column:
    x = col_of(x)
    out = F.lit(C.OTHER_DURATION_RANK)
    for name, rank in C.DURATION_RANK.items():
        out = F.when(x == name, F.lit(rank)).otherwise(out)
    return out


def keeps_event(event_type) -> Column:
    """True unless the event type is 'Excluded'; a NULL type is kept."""
    return ~col_of(event_type).eqNullSafe(F.lit("Excluded"))


def is_complete(duration, percent) -> Column:
    """Whole-day durations always pass; sub-daily rows need enough observations."""
    enough = F.coalesce(col_of(percent) >= C.MIN_OBSERVATION_PERCENT, F.lit(False))
    return F.coalesce(col_of(duration).isin(C.DAILY_DURATIONS), F.lit(False)) | enough


def pixel_index(lat, lon, lat0: float, lon0: float, step: float, height: int, width: int) -> dict[str, Column]:
    """Row, column and pixel id of the nearest grid node; all NULL off the grid."""
    row = F.rint((col_of(lat) - F.lit(lat0)) / F.lit(step)).cast("long")
    col = F.rint((col_of(lon) - F.lit(lon0)) / F.lit(step)).cast("long")
    inside = row.between(0, height - 1) & col.between(0, width - 1)
    return {
        "row": F.when(inside, row),
        "col": F.when(inside, col),
        "pixel": F.when(inside, row * F.lit(width) + col),
    }


def aqi_category(x) -> Column:
    """Category index 0..5 of a daily concentration, truncated to 0.1 first."""
    v = F.floor(F.greatest(col_of(x), F.lit(0.0)) * F.lit(10.0) + F.lit(1e-9)) / F.lit(10.0)
    index = reduce(lambda a, b: a + b, [(v > F.lit(bound)).cast("int") for bound in C.AQI_UPPER_BOUNDS])
    return F.when(col_of(x).isNotNull(), index)


def fixed_bin(x, width: float, count: int) -> Column:
    """Index of the half-open fixed-width bin; NULL outside ``[0, width * count)``."""
    index = F.floor(col_of(x) / F.lit(width)).cast("int")
    return F.when(index.between(0, count - 1), index)


def hex_bin(x, y, hi: float | Column, gridsize: int) -> dict[str, Column]:
    """Hexagon of a point on ``(0, hi)²``: the nearer of two offset lattices.

    ``lattice`` 0 holds whole-number centres, 1 the half-offset ones.
    """
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    nx, ny = gridsize, int(gridsize / math.sqrt(3))
    pad = hi * F.lit(1e-9)
    u = (col_of(x) + pad) / ((hi + pad * 2) / F.lit(float(nx)))
    v = (col_of(y) + pad) / ((hi + pad * 2) / F.lit(float(ny)))
    u1, v1, u2, v2 = F.rint(u), F.rint(v), F.floor(u), F.floor(v)
    d1 = (u - u1) * (u - u1) + F.lit(3.0) * (v - v1) * (v - v1)
    d2 = (u - u2 - 0.5) * (u - u2 - 0.5) + F.lit(3.0) * (v - v2 - 0.5) * (v - v2 - 0.5)
    whole = d1 < d2
    return {
        "lattice": F.when(whole, F.lit(0)).otherwise(F.lit(1)),
        "hx": F.when(whole, u1.cast("long")).otherwise(u2.cast("long")),
        "hy": F.when(whole, v1.cast("long")).otherwise(v2.cast("long")),
    }


def round_all(df: DataFrame, digits: int = 6, shift: float = 0.0) -> DataFrame:
    """Round every double column (plus ``shift``), for reports and comparisons."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c) + F.lit(shift), digits) for c in doubles}) if doubles else df
