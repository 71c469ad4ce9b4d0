"""Sensor-network inputs derived from the generic event and order tables.

The given tables carry no geography, so coordinates and covariates are computed
from their integer keys; every reading comes from an event or a line item, so
all inputs grow with the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Six network centres (latitude and longitude times 100).
CENTRE_LAT = [2970, 3278, 2942, 3027, 3169, 2590]
CENTRE_LON = [-9540, -9680, -9850, -9770, -10640, -9750]
ABSENT_DATE = "2024-01-05"  # missing from every gridded product


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sensor_lat(key: str) -> Column:
    k = F.col(key)
    return (_pick(CENTRE_LAT, k % 6) / F.lit(100.0) + ((k * 37) % 121 - 60) / F.lit(100.0)
            + (k % 7) / F.lit(1000.0))


def sensor_lon(key: str) -> Column:
    k = F.col(key)
    return (_pick(CENTRE_LON, k % 6) / F.lit(100.0) + ((k * 53) % 131 - 65) / F.lit(100.0)
            + (k % 11) / F.lit(1000.0))


def _rounded(x: Column) -> Column:
    """Six places; the tiny shift keeps decimal halves from rounding apart in two engines."""
    return F.round(x + F.lit(1.3e-9), 6)


def cell_centre(x: str, width: float) -> Column:
    return F.floor(F.col(x) / F.lit(width)) * F.lit(width) + F.lit(width / 2)


class Inputs:
    """Lazily built input tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        """Raw feed: one row per event with its sensor's coordinates."""
        k = F.get_json_object("props", "$.k").cast("double")
        return self.table("events").select(
            "event_id", "ts", "event_type", "value", k.alias("k"),
            F.col("user_id").alias("sensor_id"), F.to_date("ts").alias("date"),
            sensor_lat("user_id").alias("latitude"), sensor_lon("user_id").alias("longitude"))

    @cached_property
    def sensor_days(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("double")
        daily = (self.table("events")
                 .groupBy(F.col("user_id").alias("sensor_id"), F.to_date("ts").alias("date"))
                 .agg(_rounded(F.avg("value")).alias("pm25"),
                      _rounded(F.avg(k)).alias("rh"),
                      F.count(F.lit(1)).alias("n"),
                      F.count_if(F.col("event_type") == "error").alias("n_err")))
        sid, doy = F.col("sensor_id"), F.dayofyear("date")
        return daily.select(
            "sensor_id", "date", "pm25",
            F.when((sid + doy) % 29 != 0, F.col("rh")).alias("humidity"),
            (F.lit(10) + (sid * 13 + doy * 7) % 25).cast("double").alias("temperature"),
            (F.lit(990) + (sid * 7 + doy * 3) % 40).cast("double").alias("pressure"),
            ((sid * 11 + doy * 5) % 12).cast("double").alias("wind_speed"),
            ((sid * 3 + doy * 17) % 9).cast("double").alias("precipitation"),
            sensor_lat("sensor_id").alias("latitude"), sensor_lon("sensor_id").alias("longitude"),
            F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"),  # stand-ins for tract centroids
            sid.cast("string").alias("GEOID"), "n", "n_err")

    @cached_property
    def smoke(self) -> DataFrame:
        sid = F.col("sensor_id")
        return (self.sensor_days.filter("n_err > 0")
                .select(F.when(sid % 50 == 7, F.concat(F.lit("x"), sid)).otherwise(sid.cast("string")).alias("sensor_id"),
                        "date", F.least(F.lit(3), F.col("n_err")).cast("short").alias("hms_smoke")))

    @cached_property
    def daily_cells(self) -> DataFrame:
        """Daily gridded product on 0.5° cells; cells without readings are missing."""
        i, j = F.floor(F.col("latitude") / F.lit(0.5)), F.floor(F.col("longitude") / F.lit(0.5))
        return (self.readings.filter(F.col("date") != F.lit(ABSENT_DATE).cast("date"))
                .groupBy(i.alias("i"), j.alias("j"), "date")
                .agg(F.avg("k").alias("k"), F.avg("value").alias("v"))
                .select((F.col("i") * 0.5 + 0.25).alias("cell_lat"), (F.col("j") * 0.5 + 0.25).alias("cell_lon"), "date",
                        _rounded(F.col("k") / 100.0).alias("aod"),
                        _rounded(F.col("v")).alias("cams_pm25"),
                        F.when((F.abs(F.col("i") + F.col("j")) + F.dayofmonth("date")) % 5 != 0,
                               _rounded(F.col("k") * 0.3)).alias("dust"),
                        _rounded(F.col("v") * 2.0).alias("shortwave"),
                        _rounded(F.col("k") / 20.0).alias("et0"),
                        _rounded(F.col("k")).alias("cloud_cover")))

    @cached_property
    def hourly_forecast(self) -> DataFrame:
        """Hourly field on 0.25° cells with two levels."""
        return self.readings.select(
            F.date_trunc("hour", F.col("ts")).alias("time"),
            cell_centre("latitude", 0.25).alias("lat"), cell_centre("longitude", 0.25).alias("lon"),
            F.when(F.col("event_id") % 4 == 3, 1).otherwise(0).alias("lev"),
            F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("pm25_rh35_gcc"))

    @cached_property
    def hourly_species(self) -> DataFrame:
        e = F.col("event_id")
        return self.readings.select(
            F.date_trunc("hour", F.col("ts")).alias("time"),
            cell_centre("latitude", 0.5).alias("lat"), cell_centre("longitude", 0.625).alias("lon"),
            (F.col("value") * 1e-9).alias("DUSMASS25"), (F.col("k") * 1e-9).alias("OCSMASS"),
            ((e % 17) * F.lit(1e-9)).alias("BCSMASS"),
            F.when(e % 11 != 0, (e % 23) * F.lit(1e-9)).alias("SO4SMASS"),
            ((e % 5) * F.lit(1e-9)).alias("SSSMASS25"))

    @cached_property
    def hourly_boundary_layer(self) -> DataFrame:
        return self.readings.filter("event_id % 7 <> 0").select(
            F.date_trunc("hour", F.col("ts")).alias("time"),
            cell_centre("latitude", 0.5).alias("lat"), cell_centre("longitude", 0.625).alias("lon"),
            (F.lit(200.0) + F.col("k") * 10.0).alias("PBLH"))

    @cached_property
    def tracts(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(
            c.cast("string").alias("GEOID"),
            (F.lit(2590) + (c * 7919) % 1060).cast("double").__truediv__(F.lit(100.0)).alias("lat"),
            (F.lit(-10660) + (c * 104729) % 1300).cast("double").__truediv__(F.lit(100.0)).alias("lon"),
            ((c * 17) % 1000 / F.lit(10.0)).alias("traffic_proximity"),
            ((c * 19) % 1000 / F.lit(10.0)).alias("superfund_proximity"),
            ((c * 23) % 1000 / F.lit(10.0)).alias("rmp_proximity"),
            ((c * 29) % 1000 / F.lit(10.0)).alias("diesel_pm_proximity"),
            ((c * 31) % 100 / F.lit(100.0)).alias("ejf_score"),
            ((c * 37) % 100 / F.lit(100.0)).alias("pct_people_of_color"),
            ((c * 41) % 100 / F.lit(100.0)).alias("pct_low_income"),
            ((c * 43) % 100 / F.lit(100.0)).alias("pct_ling_isolated"))

    @cached_property
    def membership(self) -> DataFrame:
        sid = F.col("sensor_id")
        return (self.sensor_days.select("sensor_id").distinct().filter("sensor_id % 10 <> 8")
                .select(sid.cast("string").alias("sensor_id"),
                        F.when(sid % 10 == 9, "False").otherwise("True").alias("in_tx")))

    @cached_property
    def elevation_documents(self) -> DataFrame:
        """JSON documents of the nested-map elevation format, one per sensor; odd sensors and every third tract lack a value."""
        sid = F.col("sensor_id")
        text = F.concat(
            F.lit('{"sensors": {"'), sid,
            F.when(sid % 14 == 0, F.lit('": "bad"')).when(sid % 2 == 1, F.lit('": null')).otherwise(F.concat(F.lit('": "'), (sid * 7) % 900, F.lit('.5"'))),
            F.lit('}, "tracts": {"'), F.lpad(sid.cast("string"), 11, "0"), F.lit('": '),
            F.when(sid % 3 == 0, F.lit("null")).otherwise((sid * 11 % 800).cast("string")), F.lit("}}"))
        return self.sensor_days.select("sensor_id").distinct().select(text.alias("value"))

    def elevation_lines(self, files: int = 4) -> DataFrame:
        """(file, part, line): the same elevations as a few nested-map JSON files, an entry on each line."""
        sid = F.col("sensor_id")
        file = F.pmod(F.xxhash64("sensor_id"), F.lit(files)).alias("file")
        value = F.when(sid % 14 == 0, F.lit('"bad, {"')).when(sid % 2 == 1, F.lit("null")).otherwise(F.concat(F.lit('"'), (sid * 7) % 900, F.lit('.5"')))
        tract = F.when(sid % 3 == 0, F.lit("null")).otherwise((sid * 11 % 800).cast("string"))
        ids = self.sensor_days.select("sensor_id").distinct()
        entries = ids.select(file, F.explode(F.array(
            F.struct(F.lit(1).alias("part"), F.concat(F.lit(',"'), sid, F.lit('": '), value).alias("line")),
            F.struct(F.lit(3).alias("part"), F.concat(F.lit(',"'), F.lpad(sid.cast("string"), 11, "0"), F.lit('": '), tract).alias("line")))).alias("e")).select("file", "e.*")
        frame = [(0, '{"sensors": {"": null'), (2, '}, "tracts": {"": null'), (4, "}}")]
        edges = entries.select("file").distinct().select("file", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(t).alias("line")) for p, t in frame])).alias("e"))
        return entries.unionByName(edges.select("file", "e.*"))

    def tract_lines(self, files: int = 4) -> DataFrame:
        """(file, part, line): the tract polygons as a few GeoJSON feature collections."""
        file = F.pmod(F.xxhash64("GEOID"), F.lit(files))
        first = F.row_number().over(W.partitionBy("file").orderBy("GEOID")) == 1
        whole = F.concat(F.lit('{"properties": {"GEOID": "'), F.col("GEOID"), F.lit('", "note": "a } in \\\" text, ["}, '), F.expr("substr(value, 2)"))
        entries = self.tract_features.withColumn("file", file).select(
            "file", F.when(first, 1).otherwise(2).alias("part"), F.when(first, whole).otherwise(F.concat(F.lit(","), whole)).alias("line"))
        frame = [(0, '{"type": "FeatureCollection", "crs": {"properties": {"name": "x"}}, "features": ['), (3, "]}")]
        edges = entries.select("file").distinct().select("file", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(t).alias("line")) for p, t in frame])).alias("e"))
        return entries.unionByName(edges.select("file", "e.*"))

    @cached_property
    def tract_features(self) -> DataFrame:
        """GeoJSON feature text per tract: a polygon, or a two-part multipolygon."""
        def ring(dx: float) -> Column:
            x, y = F.col("lon") + F.lit(dx), F.col("lat")
            pts = [(x, y), (x + 0.5, y), (x + 0.5, y + 0.5), (x, y)]
            return F.array(*[F.array(a, b) for a, b in pts])

        single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring(0.0), ring(0.25)).alias("coordinates")))
        multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"),
                                   F.array(F.array(ring(0.0)), F.array(ring(1.0))).alias("coordinates")))
        geometry = F.when(F.col("GEOID").cast("long") % 3 == 0, multi).otherwise(single)
        return self.tracts.select("GEOID", F.concat(
            F.lit('{"type": "Feature", "geometry": '), geometry, F.lit("}")).alias("value"))

    @cached_property
    def reference_feed(self) -> DataFrame:
        """Regulatory annual-file rows: several instruments, durations and event types."""
        sup, line = F.col("l_suppkey"), F.col("l_linenumber")
        return self.table("lineitem").select(
            F.when(sup % 5 == 0, "6").otherwise("48").alias("State Code"),
            (sup % 254).cast("string").alias("County Code"), sup.cast("string").alias("Site Num"),
            F.when(F.col("l_tax") >= 0.08, 88502).otherwise(88101).alias("Parameter Code"),
            line.alias("POC"),
            ((F.lit(2600) + (sup * 37) % 1000) / F.lit(100.0)).alias("Latitude"),
            ((F.lit(-10600) + (sup * 53) % 1200) / F.lit(100.0)).alias("Longitude"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % 30).cast("int")).alias("Date Local"),
            F.when(F.col("l_returnflag") == "A", "24-HR BLK AVG")
             .when(F.col("l_returnflag") == "N", "1 HOUR").otherwise("24 HOUR").alias("Sample Duration"),
            F.col("l_quantity").alias("Arithmetic Mean"),
            F.when((F.col("l_linestatus") == "O") & (line % 3 == 0), "Excluded")
             .when(line % 2 == 0, "None").alias("Event Type"),
            F.when(F.col("l_partkey") % 19 != 0, (F.lit(50) + F.col("l_partkey") % 51).cast("double")).alias("Observation Percent"))
