"""Scans and ingest reductions: panel, regulatory feed, JSON/GeoJSON maps, hourly grids, month windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatiofuse import constants as C
from spatiofuse.functions import scalar as S
from spatiofuse.functions.ordering import first_per_key
from spatiofuse.sources import json_files

FEED_SCHEMA = (
    "`State Code` string, `County Code` string, `Site Num` string, `Parameter Code` int, POC int, "
    "Latitude double, Longitude double, `Date Local` date, `Sample Duration` string, "
    "`Arithmetic Mean` double, `Event Type` string, `Observation Percent` double"
)


# Panel -------------------------------------------------------------------

def sensor_day_panel(raw: DataFrame, start: str = C.DATE_START, end: str = C.DATE_END,
                     keep_demographics: bool = False) -> DataFrame:
    """Daily panel: floored date, inclusive window, readings present, canonical coordinates.

    ``lat``/``lon`` of the stored file are tract centroids; they are replaced by
    the sensor's own coordinates. NaN becomes NULL here, once.
    """
    raw = S.finite_columns(raw, ["pm25", *C.MET_COLUMNS])
    df = (raw.withColumn("date", F.to_date("date"))
          .filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
          .dropna(subset=["pm25"]).drop("lat", "lon")
          .withColumns({"lat": F.col("latitude").cast("double"), "lon": F.col("longitude").cast("double")}))
    if not keep_demographics:
        df = df.drop(*C.DEMOGRAPHIC_COLUMNS)
    if "GEOID" in df.columns:
        df = df.withColumn("GEOID", S.zero_padded("GEOID", 11))
    return df


def read_sensor_days(spark: SparkSession, path: str, **window) -> DataFrame:
    return sensor_day_panel(spark.read.parquet(path), **window)


def daily_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column-pruned scan with a true date column."""
    return df.select(*columns).withColumn("date", F.to_date("date"))


def canonical_coordinates(df: DataFrame) -> DataFrame:
    """Give a frame both spellings of its coordinates."""
    pairs = {"lat": "latitude", "lon": "longitude", "latitude": "lat", "longitude": "lon"}
    for name, source in pairs.items():
        if name not in df.columns and source in df.columns:
            df = df.withColumn(name, F.col(source).cast("double"))
    return df


def out_of_region_ids(membership: DataFrame) -> DataFrame:
    """Sensor ids audited as outside the region; ids that do not parse are skipped."""
    return (membership.select(F.col("sensor_id").try_cast("long").alias("sensor_id"),
                              (F.lower(F.col("in_tx").cast("string")) == "true").alias("inside"))
            .filter("sensor_id IS NOT NULL AND NOT coalesce(inside, false)").select("sensor_id").distinct())


def in_region_ids(membership: DataFrame) -> DataFrame:
    return (membership.select(F.col("sensor_id").try_cast("long").alias("sensor_id"),
                              (F.lower(F.col("in_tx").cast("string")) == "true").alias("inside"))
            .filter("sensor_id IS NOT NULL AND inside").select("sensor_id").distinct())


def tract_lookup(tracts: DataFrame) -> DataFrame:
    return tracts.withColumn("GEOID", S.zero_padded("GEOID", 11))


ELEVATION_SCHEMA = "sensors map<string,string>, tracts map<string,string>"


def elevation_maps(documents: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(sensor_id, elevation) and (GEOID, elevation) from nested-map JSON text; bad entries are skipped."""
    parsed = documents.select(F.from_json(column, ELEVATION_SCHEMA).alias("d"))
    sensors = (parsed.select(F.explode("d.sensors").alias("k", "v"))
               .select(F.col("k").try_cast("double").cast("long").alias("sensor_id"),
                       F.col("v").try_cast("double").alias("elevation")).dropna())
    tracts = (parsed.select(F.explode("d.tracts").alias("GEOID", "v"))
              .select("GEOID", F.col("v").try_cast("double").alias("elevation")).dropna())
    return (sensors.groupBy("sensor_id").agg(F.max("elevation").alias("elevation")),
            tracts.groupBy("GEOID").agg(F.max("elevation").alias("elevation")))


def read_elevations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same two tables from files of one document each, however large: an entry is a row."""
    entries = json_files.map_entries(spark, path)
    entries = entries.select("section", "key", F.btrim("value", F.lit('"')).try_cast("double").alias("elevation")).filter("elevation IS NOT NULL")
    sensors = entries.filter("section = 'sensors'").select(F.col("key").try_cast("double").cast("long").alias("sensor_id"), "elevation").dropna()
    tracts = entries.filter("section = 'tracts'").select(F.col("key").alias("GEOID"), "elevation")
    return (sensors.groupBy("sensor_id").agg(F.max("elevation").alias("elevation")),
            tracts.groupBy("GEOID").agg(F.max("elevation").alias("elevation")))


def exterior_rings(features: DataFrame, column: str = "value") -> DataFrame:
    """Exterior ring of each polygon part: (feature columns, part, ring)."""
    parsed = features.withColumn(
        "_g", F.from_json(column, "geometry struct<type string, coordinates string>")["geometry"])
    points = "array<array<double>>"
    single = F.array(F.from_json("_g.coordinates", f"array<{points}>"))
    multi = F.from_json("_g.coordinates", f"array<array<{points}>>")
    parts = F.when(F.col("_g.type") == "Polygon", single).when(F.col("_g.type") == "MultiPolygon", multi)
    rest = [c for c in features.columns if c != column]
    return (parsed.select(*rest, F.posexplode(parts).alias("part", "rings"))
            .select(*rest, "part", F.col("rings")[0].alias("ring")))


def read_polygons(spark: SparkSession, path: str, properties: tuple[str, ...] = ()) -> DataFrame:
    """Exterior rings of GeoJSON feature collection files, with the named properties; a feature is a row."""
    features = json_files.array_objects(spark, path, "features")
    named = [F.get_json_object("value", f"$.properties.{p}").alias(p) for p in properties]
    return exterior_rings(features.select(*named, "value"))


# Regulatory feed ---------------------------------------------------------

def read_regulatory_feed(spark: SparkSession, path: str) -> DataFrame:
    """Annual CSV files with text codes (leading zeros kept)."""
    names = [f.name for f in T.StructType.fromDDL(FEED_SCHEMA).fields]
    return spark.read.csv(path, schema=FEED_SCHEMA, header=True, enforceSchema=False).select(*names)


def regulatory_rows(feed: DataFrame, state: str = C.REGULATORY_STATE, parameter: int = C.REGULATORY_PARAMETER) -> DataFrame:
    """Rows of one state and parameter under short names."""
    return (feed.filter((F.col("State Code") == state) & (F.col("Parameter Code") == parameter))
            .select(F.col("State Code").alias("state_code"), F.col("County Code").alias("county_code"),
                    F.col("Site Num").alias("site_num"), F.col("POC").alias("poc"),
                    F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"),
                    F.to_date("Date Local").alias("date"), F.col("Sample Duration").alias("duration"),
                    F.col("Arithmetic Mean").alias("mean"), F.col("Event Type").alias("event_type"),
                    F.col("Observation Percent").alias("percent")))


def quality_filtered(rows: DataFrame) -> DataFrame:
    """Drop excluded events and incomplete sub-daily rows; add site id and duration rank."""
    return (rows.filter(S.keeps_event("event_type")).filter(S.is_complete("duration", "percent"))
            .withColumns({
                "site_id": F.concat(S.zero_padded("state_code", 2), S.zero_padded("county_code", 3),
                                    S.zero_padded("site_num", 4)),
                "dur_rank": S.duration_rank("duration")}))


def regulatory_daily(rows: DataFrame) -> DataFrame:
    """One value per site-day: copies averaged, then best duration, then lowest instrument."""
    per_instrument = (quality_filtered(rows).groupBy("site_id", "date", "poc", "dur_rank")
                      .agg(F.avg("mean").alias("pm25_aqs"), F.min("lat").alias("lat"), F.min("lon").alias("lon")))
    best = first_per_key(per_instrument, ["site_id", "date"], ["dur_rank", "poc"])
    return best.select("site_id", "date", "pm25_aqs", "lat", "lon")


# Hourly grids ------------------------------------------------------------

def in_bbox(lat="lat", lon="lon", bbox=None) -> Column:
    b = bbox or C.BBOX
    return F.col(lat).between(b["lat_min"], b["lat_max"]) & F.col(lon).between(b["lon_min"], b["lon_max"])


STATISTICS = {"mean": F.avg, "max": F.max, "min": F.min}


def daily_grid(hourly: DataFrame, variables: list[str], stats: tuple[str, ...] = ("mean",), bbox=None) -> DataFrame:
    """Daily reductions per cell: the first statistic keeps the name, later ones get a suffix."""
    aggs = [STATISTICS[s](v).alias(v if i == 0 else f"{v}_{s}") for i, s in enumerate(stats) for v in variables]
    surface = hourly.filter("lev = 0") if "lev" in hourly.columns else hourly
    surface = S.finite_columns(surface, variables)
    return (surface.filter(in_bbox(bbox=bbox))
            .groupBy(F.to_date("time").alias("date"), "lat", "lon").agg(*aggs))


FORECAST_CANDIDATES = ["pm25_rh35_gcc", "pm25_rh35_gc", "pm25"]


def forecast_daily(hourly: DataFrame, bbox=None) -> DataFrame:
    """Daily-mean surface forecast; cells without a finite value that day are dropped."""
    name = S.first_present(hourly, FORECAST_CANDIDATES)
    return (daily_grid(hourly, [name], bbox=bbox)
            .select("date", "lat", "lon", F.col(name).alias("geoscf_pm25")).dropna(subset=["geoscf_pm25"]))


def reanalysis_daily(species: DataFrame, boundary_layer: DataFrame, bbox=None) -> DataFrame:
    """Species means in µg/m³ and the mass proxy, joined to boundary-layer mean/max/min."""
    aer = daily_grid(species, list(C.SPECIES), bbox=bbox)
    flx = daily_grid(boundary_layer, ["PBLH"], ("mean", "max", "min"), bbox=bbox)
    df = aer.join(flx, ["date", "lat", "lon"])
    df = df.select(
        "date", "lat", "lon", *[(F.col(raw) * F.lit(C.SPECIES_SCALE)).alias(name) for raw, name in C.SPECIES.items()],
        F.col("PBLH").alias("merra2_pblh"), F.col("PBLH_max").alias("merra2_pblh_max"),
        F.col("PBLH_min").alias("merra2_pblh_min"))
    proxy = reduce(lambda a, b: a + b, [F.lit(w) * F.col(n) for n, w in C.PROXY_WEIGHTS.items()])
    return df.withColumn("merra2_pm25_proxy", proxy).dropna(subset=list(C.SPECIES.values()))


# Month windows, coverage and assembly --------------------------------------

def month_windows(bounds: DataFrame) -> DataFrame:
    """Calendar-month windows of the (start, end) dates, first and last clipped to the bounds."""
    month = F.explode(F.sequence(F.trunc("start", "MM"), F.trunc("end", "MM"), F.expr("INTERVAL 1 MONTH")))
    return (bounds.select("start", "end", month.alias("month"))
            .select(F.date_format("month", "yyyyMM").alias("tag"),
                    F.greatest("month", "start").alias("lo"), F.least(F.last_day("month"), "end").alias("hi")))


def covers_window(dates: DataFrame, start, end) -> DataFrame:
    """One row: does the table's first/last month span the window's months (an empty table does not)."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x).cast("date") for x in (start, end))
    return (dates.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
            .withColumn("covers", F.coalesce(
                (F.trunc("first_date", "MM") <= F.trunc(lo, "MM")) & (F.trunc("last_date", "MM") >= F.trunc(hi, "MM")),
                F.lit(False))))


def month_gaps(windows: DataFrame, table: DataFrame, previously_failed: DataFrame) -> DataFrame:
    """Windows whose month has no row yet, months that failed before first."""
    present = table.select(F.date_format("date", "yyyyMM").alias("tag")).distinct()
    failed = previously_failed.select("tag").distinct().withColumn("failed_before", F.lit(True))
    return (windows.join(present, "tag", "left_anti").join(failed, "tag", "left")
            .withColumn("failed_before", F.coalesce("failed_before", F.lit(False))))


def retry_order(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(F.desc("failed_before"), "tag")


def assemble_months(chunks: list[DataFrame], start: str | None = None, end: str | None = None) -> DataFrame:
    """Union month chunks (absent columns become NULL) and keep the window."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chunks)
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out


def write_by_month(df: DataFrame, path: str, order: list[str]) -> None:
    """Month-partitioned parquet, sorted inside each file."""
    (df.withColumn("month", F.date_format("date", "yyyyMM"))
     .repartitionByRange("month", *order)  # ranges of even size: a heavy month takes as many tasks as it fills
     .sortWithinPartitions("month", *order)
     .write.mode("overwrite").partitionBy("month").parquet(path))



def lag_correlation(a: DataFrame, b: DataFrame, a_value: str, b_value: str, lags=range(-3, 4)) -> DataFrame:
    """Correlation of two products' daily regional means at each day lag (lag added to ``a``)."""
    left = a.groupBy("date").agg(F.avg(a_value).alias("x"))
    right = b.groupBy("date").agg(F.avg(b_value).alias("y"))
    shifted = (left.withColumn("lag", F.explode(F.array(*[F.lit(i) for i in lags])))
               .withColumn("date", F.date_add("date", F.col("lag"))))
    return shifted.join(right, "date").groupBy("lag").agg(
        F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n_days"))
