"""Scans, ingest reductions, row expressions and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatiofuse import constants as C
from spatiofuse.functions import scalar as S
from spatiofuse.functions.ordering import first_per_key, sampled, capped_per_key
from spatiofuse.operators.grid import grid_over, calendar_planes
from spatiofuse.operators.metrics import residual_columns
from spatiofuse.plans.catalog.base import folded, panel, query, reference_daily
from spatiofuse.plans.catalog.sqltext import SITE_ID, hav, out, sql
from spatiofuse.plans.features import feature_columns
from spatiofuse.session import cut_lineage, new_path
from spatiofuse.sources import ingest, sinks

PANEL_COLUMNS = ["sensor_id", "date", "pm25", "humidity", "temperature", "lat", "lon", "GEOID", "target"]


@query("sensor_day_scan", sql(out("""
SELECT sensor_id, date, pm25, humidity, temperature, lat, lon, GEOID, target FROM panel""",
    "pm25 humidity temperature lat lon target"), "panel"))
def sensor_day_scan(i):
    return panel(i).select(*PANEL_COLUMNS)


@query("daily_column_scan", sql(out("""
SELECT date, COUNT(*) AS n, AVG(pm25) AS mean_pm25, MAX(temperature) AS max_temperature FROM sensor_days GROUP BY date""",
    "mean_pm25 max_temperature"), "sensor_days"))
def daily_column_scan(i):
    return (ingest.daily_columns(i.sensor_days, ["date", "pm25", "temperature"]).groupBy("date")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("pm25").alias("mean_pm25"), F.max("temperature").alias("max_temperature")))


@query("regulatory_feed_scan", sql(out("""
SELECT state_code, county_code, site_num, poc, latitude AS lat, longitude AS lon, date, duration, mean, event_type, percent
FROM reference_feed WHERE state_code = '48' AND parameter_code = 88101""", "lat lon mean percent"), "reference_feed"))
def regulatory_feed_scan(i):
    return ingest.regulatory_rows(i.reference_feed)


@query("out_of_region_ids", sql("""
SELECT CAST(sensor_id AS BIGINT) AS sensor_id FROM membership WHERE lower(in_tx) <> 'true'""", "membership"))
def out_of_region_ids(i):
    return ingest.out_of_region_ids(i.membership)


ELEVATION_SQL = sql("""
SELECT CAST(sensor_id AS VARCHAR) AS id, 'sensor' AS kind, round((sensor_id*7) % 900 + 0.5, 6)::DOUBLE AS elevation FROM ids WHERE sensor_id % 14 <> 0 AND sensor_id % 2 = 0
UNION ALL SELECT lpad(CAST(sensor_id AS VARCHAR), 11, '0'), 'tract', (sensor_id*11 % 800)::DOUBLE FROM ids WHERE sensor_id % 3 <> 0""",
    "sensor_days", ids="SELECT DISTINCT sensor_id FROM sensor_days")


def elevation_rows(sensors, tracts):
    return (sensors.select(F.col("sensor_id").cast("string").alias("id"), F.lit("sensor").alias("kind"), "elevation")
            .unionByName(tracts.select(F.col("GEOID").alias("id"), F.lit("tract").alias("kind"), "elevation")))


@query("elevation_map_scan", ELEVATION_SQL)
def elevation_map_scan(i):
    return elevation_rows(*ingest.elevation_maps(i.elevation_documents))


@query("elevation_file_scan", ELEVATION_SQL)
def elevation_file_scan(i):
    path = new_path(i.spark, "elevations")
    sinks.write_documents(i.elevation_lines(), path)
    return elevation_rows(*ingest.read_elevations(i.spark, path))


@query("tract_lookup_scan", sql(out("""
SELECT lpad(GEOID, 11, '0') AS GEOID, lat, lon, traffic_proximity FROM tracts""", "lat lon traffic_proximity", ""), "tracts"))
def tract_lookup_scan(i):
    return ingest.tract_lookup(i.tracts).select("GEOID", "lat", "lon", "traffic_proximity")


RINGS_SQL = sql(out("""
SELECT GEOID, 0 AS part, 4 AS n_points, lon AS x0, lat AS y0, lon + 0.5 AS x_max FROM tracts
UNION ALL SELECT GEOID, 1, 4, lon + 1.0, lat, lon + 1.5 FROM tracts WHERE CAST(GEOID AS BIGINT) % 3 = 0""",
    "x0 y0 x_max", ""), "tracts")


def ring_rows(r):
    return r.select("GEOID", "part", F.size("ring").alias("n_points"), F.col("ring")[0][0].alias("x0"),
                    F.col("ring")[0][1].alias("y0"), F.array_max(F.transform("ring", lambda p: p[0])).alias("x_max"))


@query("polygon_rings", RINGS_SQL)
def polygon_rings(i):
    return ring_rows(ingest.exterior_rings(i.tract_features))


@query("polygon_file_scan", RINGS_SQL)
def polygon_file_scan(i):
    path = new_path(i.spark, "tracts")
    sinks.write_documents(i.tract_lines(), path)
    return ring_rows(ingest.read_polygons(i.spark, path, ("GEOID",)))


@query("forecast_daily_mean", sql(out("SELECT date, lat, lon, geoscf_pm25 FROM forecast_daily", "lat lon geoscf_pm25"), "forecast_daily"))
def forecast_daily_mean(i):
    return ingest.forecast_daily(i.hourly_forecast)


@query("boundary_layer_daily_stats", sql(out("""
SELECT CAST(time AS DATE) AS date, lat, lon, AVG(PBLH) AS PBLH, MAX(PBLH) AS PBLH_max, MIN(PBLH) AS PBLH_min
FROM hourly_boundary_layer WHERE lat BETWEEN 25.6 AND 36.7 AND lon BETWEEN -107.0 AND -93.3 GROUP BY 1, 2, 3""",
    "lat lon PBLH PBLH_max PBLH_min"), "hourly_boundary_layer"))
def boundary_layer_daily_stats(i):
    return ingest.daily_grid(i.hourly_boundary_layer, ["PBLH"], ("mean", "max", "min"))


@query("species_merge_proxy", sql(out("SELECT * FROM reanalysis_daily",
    "lat lon merra2_dust25 merra2_oc merra2_bc merra2_so4 merra2_ss25 merra2_pblh merra2_pblh_max merra2_pblh_min merra2_pm25_proxy"),
    "reanalysis_daily"))
def species_merge_proxy(i):
    return ingest.reanalysis_daily(i.hourly_species, i.hourly_boundary_layer)


WINDOWS = """
SELECT strftime(m, '%Y%m') AS tag, greatest(m, s) AS lo, least(CAST(m + INTERVAL 1 MONTH AS DATE) - 1, e) AS hi
FROM (SELECT CAST(unnest(generate_series(date_trunc('month', s), date_trunc('month', e), INTERVAL 1 MONTH)) AS DATE) AS m, s, e
      FROM (SELECT CAST(MIN(o_orderdate) AS DATE) AS s, CAST(MAX(o_orderdate) AS DATE) AS e FROM orders))"""


def _order_windows(i):
    bounds = i.table("orders").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return ingest.month_windows(bounds)


def _shipped(i):
    """Line items as a dated table with some months missing."""
    return (i.table("lineitem").select(F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_quantity")
            .filter(F.month("date") % 5 != 0))


@query("month_windows", out(WINDOWS, "", "lo hi"))
def month_windows(i):
    return _order_windows(i)


@query("month_coverage", out("""
SELECT MIN(d) AS first_date, MAX(d) AS last_date,
       coalesce(date_trunc('month', MIN(d)) <= date_trunc('month', MIN(s)) AND date_trunc('month', MAX(d)) >= date_trunc('month', MIN(e)), false) AS covers
FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem),
     (SELECT CAST(MIN(o_orderdate) AS DATE) AS s, CAST(MAX(o_orderdate) AS DATE) AS e FROM orders)""", "", "first_date last_date"))
def month_coverage(i):
    bounds = i.table("orders").agg(F.to_date(F.min("o_orderdate")).alias("s"), F.to_date(F.max("o_orderdate")).alias("e"))
    dates = i.table("lineitem").select(F.to_date("l_shipdate").alias("date"))
    return ingest.covers_window(dates, bounds.select("s").scalar(), bounds.select("e").scalar())


@query("month_gap_report", out(f"""
SELECT w.tag, w.lo, w.hi, (w.tag LIKE '%05') AS failed_before FROM ({WINDOWS}) w
WHERE w.tag NOT IN (SELECT strftime(l_shipdate, '%Y%m') FROM lineitem WHERE month(l_shipdate) % 5 <> 0)""", "", "lo hi"))
def month_gap_report(i):
    windows = _order_windows(i)
    failed = windows.filter(F.col("tag").endswith("05")).select("tag")
    return ingest.retry_order(ingest.month_gaps(windows, _shipped(i), failed))


@query("assembled_months", """
SELECT strftime(l_shipdate, '%Y') AS year, COUNT(*) AS n, COUNT(CASE WHEN year(l_shipdate) >= 1995 THEN l_quantity END) AS n_quantity
FROM lineitem WHERE month(l_shipdate) % 5 <> 0 AND l_shipdate >= DATE '1993-02-10' AND CAST(l_shipdate AS DATE) <= DATE '1997-11-20' GROUP BY 1""")
def assembled_months(i):
    s = _shipped(i)
    old = s.filter(F.year("date") < 1995).drop("l_quantity")  # chunks from before the column existed
    new = s.filter(F.year("date") >= 1995)
    return (ingest.assemble_months([old, new], "1993-02-10", "1997-11-20").groupBy(F.date_format("date", "yyyy").alias("year"))
            .agg(F.count(F.lit(1)).alias("n"), F.count("l_quantity").alias("n_quantity")))


@query("frame_key_check", sql("""
SELECT 0::BIGINT AS only_left, COUNT(*) FILTER (target IS NULL)::BIGINT AS only_right, COUNT(*) FILTER (target IS NOT NULL)::BIGINT AS shared FROM panel""", "panel"))
def frame_key_check(i):
    p = panel(i)
    return sinks.key_differences(p.filter("target IS NOT NULL"), p, ["sensor_id", "date"])


@query("frame_reload", sql("""
SELECT 'as written' AS step, COUNT(*) AS n, 0::BIGINT AS only_left, 0::BIGINT AS only_right FROM panel
UNION ALL SELECT 'repeated row', COUNT(*), 1, 0 FROM panel UNION ALL SELECT 'lost day', COUNT(*), 0, COUNT(*) FILTER (date = (SELECT MIN(date) FROM panel)) FROM panel""", "panel"))
def frame_reload(i):
    """Write the panel with its manifest and reload it, as it is, with one row planted twice, and without a day."""
    keys, p = ["sensor_id", "date"], cut_lineage(panel(i))
    first = p.orderBy(*keys).limit(1)
    steps = {"as written": p, "repeated row": p.unionByName(first), "lost day": p.join(p.select(F.min("date").alias("date")), "date", "left_anti")}
    found = []
    for step, frame in steps.items():
        path = new_path(i.spark, "frame")
        sinks.write_frame(frame, path, keys=keys)
        try:
            sinks.reload_frame(i.spark, path, p, keys)
            found.append((step, 0, 0))
        except sinks.FrameMismatch as e:
            found.append((step, e.differences["only_left"], e.differences["only_right"]))
    report = i.spark.createDataFrame(found, "step string, only_left long, only_right long")
    return report.select("step", F.lit(p.count()).cast("long").alias("n"), "only_left", "only_right")


@query("humidity_correction", sql(out("""
SELECT sensor_id, date, pm25, humidity, greatest(0.524*pm25 - 0.0862*humidity + 5.75, 0.0) + 0*humidity AS corrected, pm25 AS raw
FROM sensor_days""", "pm25 humidity corrected raw"), "sensor_days"))
def humidity_correction(i):
    corrected = S.with_target(i.sensor_days).withColumnRenamed("target", "corrected")
    return (S.with_target(corrected, "raw").withColumnRenamed("target", "raw")
            .select("sensor_id", "date", "pm25", "humidity", "corrected", "raw"))


COAST_SQL = "least(" + ", ".join(hav("latitude", "longitude", f"{a}::DOUBLE", f"({b})::DOUBLE") for a, b in C.COAST_POINTS) + ")"


@query("coast_distance", sql(out(f"""
SELECT sensor_id, date, {COAST_SQL} AS dist_to_coast, {hav('latitude', 'longitude', '29.76::DOUBLE', '(-95.37)::DOUBLE')} AS dist_to_centre FROM sensor_days""",
    "dist_to_coast dist_to_centre"), "sensor_days"))
def coast_distance(i):
    return i.sensor_days.select("sensor_id", "date", S.distance_to_points("latitude", "longitude").alias("dist_to_coast"),
                                S.haversine_km("latitude", "longitude", F.lit(29.76), F.lit(-95.37)).alias("dist_to_centre"))


@query("calendar_features", sql(out("""
SELECT sensor_id, date, month(date) AS month, isodow(date) - 1 AS dow, dayofyear(date) AS day_of_year,
       sin(2*pi()*month(date)/12) AS month_sin, cos(2*pi()*month(date)/12) AS month_cos,
       sin(2*pi()*(isodow(date)-1)/7) AS dow_sin, cos(2*pi()*(isodow(date)-1)/7) AS dow_cos,
       sin(2*pi()*dayofyear(date)/365) AS doy_sin, cos(2*pi()*dayofyear(date)/365) AS doy_cos,
       temperature*humidity/100 AS temp_x_humidity, wind_speed*temperature/100 AS wind_x_temp FROM panel""",
    "month_sin month_cos dow_sin dow_cos doy_sin doy_cos temp_x_humidity wind_x_temp"), "panel"))
def calendar_features(i):
    df = S.with_interactions(S.with_calendar(panel(i)))
    return df.select("sensor_id", "date", *C.TIME_COLUMNS, "temp_x_humidity", "wind_x_temp")


@query("order_calendar_features", out("""
SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n, isodow(o_orderdate) - 1 AS dow, dayofyear(o_orderdate) AS day_of_year,
       sin(2*pi()*dayofyear(o_orderdate)/365) AS doy_sin FROM orders GROUP BY o_orderdate""", "doy_sin"))
def order_calendar_features(i):
    per_day = i.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return S.with_calendar(per_day).select("date", "n", "dow", "day_of_year", "doy_sin")


@query("grid_calendar_planes", sql(out("""
SELECT date, channel, COUNT(*) * 0 + 1 AS per_pixel, value FROM (
  SELECT DISTINCT date, unnest(['doy_sin','doy_cos','dow_sin','dow_cos']) AS channel,
    unnest([sin(2*pi()*dayofyear(date)/365.25), cos(2*pi()*dayofyear(date)/365.25), sin(2*pi()*(isodow(date)-1)/7), cos(2*pi()*(isodow(date)-1)/7)]) AS value
  FROM panel) GROUP BY date, channel, value""", "value"), "panel"))
def grid_calendar_planes(i):
    g = grid_over(i.tracts, 1.0)
    planes = calendar_planes(panel(i), g, with_dow=True)
    n = F.count_distinct("row", "col") / F.lit(g.height * g.width)
    return planes.groupBy("date", "channel").agg(n.cast("long").alias("per_pixel"), F.avg("value").alias("value"))


@query("guaranteed_columns", sql(out("""
SELECT sensor_id, date, aod, cloud, humidity FROM (SELECT sensor_id, date, NULL::DOUBLE AS aod, NULL::DOUBLE AS cloud, humidity FROM sensor_days)""",
    "aod cloud humidity"), "sensor_days"))
def guaranteed_columns(i):
    return S.with_missing_columns(i.sensor_days, ["aod", "cloud", "humidity"]).select("sensor_id", "date", "aod", "cloud", "humidity")


@query("feature_contract", sql(out("""
SELECT sensor_id, date, 36::BIGINT AS n_features, humidity FROM panel""", "humidity"), "panel"))
def feature_contract(i):
    df = S.with_missing_columns(panel(i), [*C.PHYSICAL_FEATURES, *C.EXTRA_FEATURES, *C.FORECAST_FEATURES])
    feats = feature_columns(df)
    return df.select("sensor_id", "date", *feats).select("sensor_id", "date", F.lit(len(feats)).cast("long").alias("n_features"), "humidity")


@query("numeric_coercion", sql(out("""
SELECT TRY_CAST(sensor_id AS BIGINT) AS sensor_id, date, hms_smoke FROM smoke WHERE TRY_CAST(sensor_id AS BIGINT) IS NOT NULL"""), "smoke"))
def numeric_coercion(i):
    return (i.smoke.withColumn("sensor_id", F.col("sensor_id").try_cast("long")).filter("sensor_id IS NOT NULL")
            .select("sensor_id", "date", "hms_smoke"))


@query("regulatory_quality_filter", sql(f"""
SELECT {SITE_ID} AS site_id, duration, coalesce(event_type, 'missing') AS event_type,
       CASE duration WHEN '24-HR BLK AVG' THEN 0 WHEN '1 HOUR' THEN 1 ELSE 2 END AS dur_rank, COUNT(*) AS n
FROM reference_feed WHERE state_code = '48' AND parameter_code = 88101 AND event_type IS DISTINCT FROM 'Excluded'
  AND (duration IN ('24-HR BLK AVG', '24 HOUR') OR coalesce(percent >= 75, false)) GROUP BY 1, 2, 3, 4""", "reference_feed"))
def regulatory_quality_filter(i):
    rows = ingest.quality_filtered(ingest.regulatory_rows(i.reference_feed))
    return rows.groupBy("site_id", "duration", F.coalesce("event_type", F.lit("missing")).alias("event_type"), "dur_rank").agg(F.count(F.lit(1)).alias("n"))


@query("regulatory_daily", sql(out("SELECT site_id, date, pm25_aqs, lat, lon FROM reference_daily", "pm25_aqs lat lon"), "reference_daily"))
def regulatory_daily(i):
    return reference_daily(i)


@query("pixel_snap", sql(out("""
SELECT sensor_id, date, CASE WHEN ok THEN r::BIGINT END AS "row", CASE WHEN ok THEN c::BIGINT END AS col, CASE WHEN ok THEN (r*138 + c)::BIGINT END AS pixel
FROM (SELECT *, r BETWEEN 0 AND 111 AND c BETWEEN 0 AND 137 AS ok FROM (
  SELECT sensor_id, date, round_even((lat - 25.6::DOUBLE)/0.1::DOUBLE, 0)::DOUBLE AS r, round_even((lon + 107.0::DOUBLE)/0.1::DOUBLE, 0)::DOUBLE AS c FROM panel))"""), "panel"))
def pixel_snap(i):
    return panel(i).withColumns(S.pixel_index("lat", "lon", 25.6, -107.0, 0.1, 112, 138)).select("sensor_id", "date", "row", "col", "pixel")


AQI_SQL = "(({0} > 9.0)::INT + ({0} > 35.4)::INT + ({0} > 55.4)::INT + ({0} > 125.4)::INT + ({0} > 225.4)::INT)"


def aqi_sql(x: str) -> str:
    return AQI_SQL.format(f"(floor(greatest({x}, 0.0)*10.0::DOUBLE + 1e-9)/10.0)")


@query("aqi_category", sql(f"""
SELECT {aqi_sql('pm25')} AS category, COUNT(*) AS n, COUNT(target) AS n_target FROM panel GROUP BY 1""", "panel"))
def aqi_category(i):
    return panel(i).groupBy(S.aqi_category("pm25").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("n_target"))


@query("residual_columns", sql(out("""
SELECT sensor_id, date, pm25 - target AS bias, target - pm25 AS residual,
       target - AVG(target) OVER (PARTITION BY sensor_id) AS y_anomaly, pm25 - AVG(pm25) OVER (PARTITION BY sensor_id) AS pred_anomaly
FROM panel WHERE target IS NOT NULL""", "bias residual y_anomaly pred_anomaly"), "panel"))
def residuals(i):
    return residual_columns(panel(i), "target", "pm25").select("sensor_id", "date", "bias", "residual", "y_anomaly", "pred_anomaly")


@query("clipped_prediction", sql(out("""
SELECT sensor_id, date, CASE WHEN target IS NOT NULL THEN greatest(target - 20, 0) END AS clipped FROM panel""", "clipped"), "panel"))
def clipped_prediction(i):
    return panel(i).select("sensor_id", "date", S.clip_low(F.col("target") - 20).alias("clipped"))


@query("canonical_coordinates", sql(out("""
SELECT sensor_id, date, lat, lon, lat AS latitude, lon AS longitude FROM panel""", "lat lon latitude longitude"), "panel"))
def canonical_coordinates(i):
    return ingest.canonical_coordinates(i.sensor_days.drop("lat", "lon")).select("sensor_id", "date", "lat", "lon", "latitude", "longitude")


@query("humidity_bins", sql("""
SELECT CASE WHEN floor(humidity/2.5) BETWEEN 0 AND 39 THEN floor(humidity/2.5)::INT ELSE -1 END AS bin, COUNT(*) AS n FROM panel GROUP BY 1""", "panel"))
def humidity_bins(i):
    return panel(i).groupBy(F.coalesce(S.fixed_bin("humidity", 2.5, 40), F.lit(-1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("latest_reading", sql(out("""
SELECT sensor_id, date, pm25 FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY date DESC) AS rn FROM panel) WHERE rn = 1""",
    "pm25"), "panel"))
def latest_reading(i):
    return first_per_key(panel(i), ["sensor_id"], [F.desc("date")]).select("sensor_id", "date", "pm25")


@query("daily_capped_sample", sql(out("""
SELECT sensor_id, date, fold FROM (SELECT *, row_number() OVER (PARTITION BY fold, date ORDER BY md5('42:' || sensor_id || ':' || date)) AS rn FROM folded) WHERE rn <= 5"""), "folded"))
def daily_capped_sample(i):
    return capped_per_key(folded(i), ["fold", "date"], 42, ["sensor_id", "date"], 5).select("sensor_id", "date", "fold")


@query("seeded_sample", sql(out("""
SELECT sensor_id, date, pm25 FROM panel ORDER BY md5('7:' || sensor_id || ':' || date) LIMIT 500""", "pm25"), "panel"))
def seeded_sample(i):
    return sampled(panel(i), 500, 7, ["sensor_id", "date"]).select("sensor_id", "date", "pm25")


@query("second_tier_merge", sql(out("""
SELECT site_id, date, pm25_aqs AS pred_tier1, CASE WHEN day(date) % 2 = 0 THEN pm25_aqs + 1 END AS pred_tier3 FROM reference_daily""",
    "pred_tier1 pred_tier3"), "reference_daily"))
def second_tier_merge(i):
    rows = reference_daily(i).select("site_id", "date", F.col("pm25_aqs").alias("pred_tier1"), F.lit(-1.0).alias("pred_tier3"))
    second = (reference_daily(i).filter(F.dayofmonth("date") % 2 == 0)
              .select("site_id", "date", (F.col("pm25_aqs") + 1).alias("pred_tier3")))
    return sinks.with_second_tier(rows, second, ["site_id", "date"], "pred_tier3")
