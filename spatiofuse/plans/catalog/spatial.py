"""Spatial joins, feature assembly, gridding and interpolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatiofuse import constants as C
from spatiofuse.operators import baselines, grid, kriging, metrics, nearest, neighbors, variogram
from spatiofuse.operators.folds import held_out_ids
from spatiofuse.plans import features
from spatiofuse.plans.catalog.base import folded, panel, query, reference_daily, sources
from spatiofuse.plans.catalog.sqltext import deg, hav, out, sql
from spatiofuse.session import cut_lineage
from spatiofuse.sources import ingest

NBR = " ".join(c for c in C.NEIGHBOR_COLUMNS if "count" not in c)

PAIRS = f"""SELECT a.sensor_id, a.date, b.sensor_id AS other, b.target AS v, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d
FROM panel a JOIN panel b ON a.date = b.date AND a.sensor_id <> b.sensor_id AND b.target IS NOT NULL"""
NEAR = """SELECT sensor_id, date, AVG(v) FILTER (d <= 25) AS m25, COUNT(*) FILTER (d <= 25) AS c25, AVG(v) FILTER (d <= 50) AS m50,
 COUNT(*) FILTER (d <= 50) AS c50, stddev_pop(v) FILTER (d <= 50) AS s50, AVG(v) AS m100, COUNT(*) AS c100
FROM pairs WHERE d <= 100 GROUP BY 1, 2"""
DAYS = "SELECT date, SUM(target) AS day_sum, COUNT(target) AS day_n FROM panel GROUP BY 1"
NEIGHBORS = """SELECT p.sensor_id, p.date, p.target, coalesce(m25, f50) AS nbr_pm25_25km, coalesce(c25, 0)::INT AS nbr_count_25km,
 f50 AS nbr_pm25_50km, coalesce(c50, 0)::INT AS nbr_count_50km, CASE WHEN c50 > 1 THEN s50 ELSE 0.0 END AS nbr_std_50km,
 coalesce(m100, f50) AS nbr_pm25_100km, coalesce(c100, 0)::INT AS nbr_count_100km
FROM (SELECT p.*, n.*  EXCLUDE (sensor_id, date), coalesce(m50, (day_sum - target)/greatest(day_n - 1, 1), (SELECT AVG(target) FROM panel)) AS f50
      FROM panel p LEFT JOIN near n ON p.sensor_id = n.sensor_id AND p.date = n.date JOIN days d ON p.date = d.date) p"""
NBR_CTES = {"pairs": PAIRS, "near": NEAR, "days": DAYS, "nbr": NEIGHBORS}

REGRESSION = """CASE WHEN var_pop(y) > 0 THEN 1 - SUM((p-y)*(p-y))/(var_pop(y)*COUNT(*)) END AS r2, sqrt(AVG((p-y)*(p-y))) AS rmse,
 AVG(abs(p-y)) AS mae, AVG(p-y) AS bias, COUNT(*) AS n"""


@query("neighbor_features", sql(out("SELECT sensor_id, date, " + ", ".join(C.NEIGHBOR_COLUMNS) + " FROM nbr", NBR), "panel", **NBR_CTES))
def neighbor_features(i):
    return neighbors.with_neighbor_features(panel(i)).select("sensor_id", "date", *C.NEIGHBOR_COLUMNS)


@query("neighbor_predictor_by_day", sql(out(f"""SELECT date, {REGRESSION} FROM (SELECT date, target AS y, nbr_pm25_50km AS p FROM nbr
WHERE target IS NOT NULL) GROUP BY date""", "r2 rmse mae bias"), "panel", **NBR_CTES))
def neighbor_predictor_by_day(i):
    df = neighbors.with_neighbor_features(panel(i))
    return metrics.regression_metrics(df, "target", "nbr_pm25_50km", ["date"])


def other_pool_sql(strict: bool) -> str:
    """Neighbours in another network: a pool where some sensors have no reading and others have moved."""
    own = "coalesce(o.own, 0)" if strict else "p.target"
    one = "CASE WHEN o.own IS NOT NULL THEN 1 ELSE 0 END" if strict else "1"
    return sql(out(f"""
SELECT p.sensor_id, p.date, coalesce(m25, f50) AS nbr_pm25_25km, coalesce(c100, 0)::INT AS nbr_count_100km, f50 AS nbr_pm25_50km
FROM (SELECT p.*, n.* EXCLUDE (sensor_id, date), coalesce(m50, CASE WHEN p.target IS NOT NULL THEN (day_sum - {own})/greatest(day_n - {one}, 1) END, (SELECT AVG(target) FROM pool)) AS f50
      FROM panel p LEFT JOIN near n ON p.sensor_id = n.sensor_id AND p.date = n.date LEFT JOIN days d ON p.date = d.date
      LEFT JOIN (SELECT sensor_id, date, target AS own FROM pool WHERE target IS NOT NULL) o ON o.sensor_id = p.sensor_id AND o.date = p.date) p""", "nbr_pm25_25km nbr_pm25_50km"),
    "panel", pool="""SELECT * REPLACE (CASE WHEN sensor_id % 3 <> 0 AND day(date) <> 9 THEN target END AS target,
      CASE WHEN sensor_id % 4 = 1 THEN lat + 0.05::DOUBLE ELSE lat END AS lat) FROM panel""",
    pairs=PAIRS.replace("JOIN panel b", "JOIN pool b"), near=NEAR, days=DAYS.replace("FROM panel", "FROM pool"))


def other_pool(i, strict: bool):
    pool = panel(i).withColumns({
        "target": F.when((F.col("sensor_id") % 3 != 0) & (F.dayofmonth("date") != 9), F.col("target")),
        "lat": F.when(F.col("sensor_id") % 4 == 1, F.col("lat") + 0.05).otherwise(F.col("lat"))})
    return (neighbors.with_neighbor_features(panel(i), pool, "target", strict=strict)
            .select("sensor_id", "date", "nbr_pm25_25km", "nbr_count_100km", "nbr_pm25_50km"))


@query("neighbor_features_other_pool", other_pool_sql(True))
def neighbor_features_other_pool(i):
    return other_pool(i, True)


@query("neighbor_features_other_pool_compat", other_pool_sql(False))
def neighbor_features_other_pool_compat(i):
    return other_pool(i, False)


@query("pool_day_totals", sql(out("""SELECT date, COUNT(target) AS day_n, SUM(target) AS day_sum, AVG(SUM(target)) OVER () AS mean_sum
FROM panel GROUP BY date""", "day_sum mean_sum"), "panel"))
def pool_day_totals(i):
    days = neighbors.day_totals(panel(i), "target")
    return days.withColumn("mean_sum", days.select(F.avg("day_sum")).scalar())


def fold_sql(strict: bool) -> str:
    own = "CASE WHEN p.fold <> f.f THEN target ELSE 0 END" if strict else "target"
    one = "CASE WHEN p.fold <> f.f THEN 1 ELSE 0 END" if strict else "1"
    return sql(out(f"""SELECT f AS fold_out, sensor_id, date, coalesce(m25, f50) AS nbr_pm25_25km, coalesce(c25, 0)::INT AS nbr_count_25km,
 f50 AS nbr_pm25_50km, coalesce(c50, 0)::INT AS nbr_count_50km, CASE WHEN c50 > 1 THEN s50 ELSE 0.0 END AS nbr_std_50km,
 coalesce(m100, f50) AS nbr_pm25_100km, coalesce(c100, 0)::INT AS nbr_count_100km
FROM (SELECT f.f, p.sensor_id, p.date, n.* EXCLUDE (f, sensor_id, date),
        coalesce(m50, CASE WHEN target IS NOT NULL THEN (day_sum - {own})/greatest(day_n - {one}, 1) END, g) AS f50
      FROM folded p CROSS JOIN fs f LEFT JOIN near n ON n.f = f.f AND p.sensor_id = n.sensor_id AND p.date = n.date
      LEFT JOIN days d ON d.f = f.f AND p.date = d.date JOIN grands g ON g.f = f.f)""", NBR),
        "folded", fs="SELECT DISTINCT fold AS f FROM folded",
        raw_pairs=PAIRS.replace("FROM panel a JOIN panel b", "FROM folded a JOIN folded b").replace("b.target AS v", "b.target AS v, b.fold AS bf"),
        close="SELECT * FROM raw_pairs WHERE d <= 100",
        pairs="SELECT fs.f, c.* FROM close c JOIN fs ON c.bf <> fs.f",
        near=NEAR.replace("SELECT sensor_id", "SELECT f, sensor_id").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3"),
        days="SELECT f, date, SUM(target) AS day_sum, COUNT(target) AS day_n FROM folded JOIN fs ON fold <> f GROUP BY 1, 2",
        grands="SELECT f, AVG(target) AS g FROM folded JOIN fs ON fold <> f GROUP BY 1")


@query("neighbor_features_per_fold", fold_sql(True))
def neighbor_features_per_fold(i):
    return neighbors.neighbor_features_per_fold(folded(i))


@query("neighbor_features_per_fold_compat", fold_sql(False))
def neighbor_features_per_fold_compat(i):
    return neighbors.neighbor_features_per_fold(folded(i), strict=False)


CELL_MAP = f"""SELECT lat, lon, clat, clon FROM (SELECT s.lat, s.lon, c.cell_lat AS clat, c.cell_lon AS clon,
 row_number() OVER (PARTITION BY s.lat, s.lon ORDER BY {deg('s.lat', 's.lon', 'c.cell_lat', 'c.cell_lon')}, c.cell_lat, c.cell_lon) AS rn
FROM (SELECT DISTINCT lat, lon FROM panel) s, (SELECT DISTINCT cell_lat, cell_lon FROM daily_cells) c) WHERE rn = 1"""


@query("nearest_cell_join", sql(out("""SELECT p.sensor_id, p.date, c.aod, c.cams_pm25, c.dust FROM panel p JOIN cell_map m ON p.lat = m.lat AND p.lon = m.lon
LEFT JOIN daily_cells c ON c.cell_lat = m.clat AND c.cell_lon = m.clon AND c.date = p.date""", "aod cams_pm25 dust"), "panel", "daily_cells", cell_map=CELL_MAP))
def nearest_cell_join(i):
    return (nearest.with_nearest_cell(panel(i), i.daily_cells, ["aod", "cams_pm25", "dust"], "cell_lat", "cell_lon")
            .select("sensor_id", "date", "aod", "cams_pm25", "dust"))


def product_map(name: str, site: str = "panel") -> str:
    return f"""SELECT lat, lon, clat, clon FROM (SELECT s.lat, s.lon, c.lat AS clat, c.lon AS clon,
 row_number() OVER (PARTITION BY s.lat, s.lon ORDER BY {deg('s.lat', 's.lon', 'c.lat', 'c.lon')}, c.lat, c.lon) AS rn
FROM (SELECT DISTINCT lat, lon FROM {site}) s, (SELECT DISTINCT lat, lon FROM {name}) c) WHERE rn = 1"""


@query("external_attach", sql(out("""SELECT p.sensor_id, p.date, f.geoscf_pm25, r.merra2_so4, r.merra2_pblh_max, r.merra2_pm25_proxy FROM panel p
JOIN fmap m ON p.lat = m.lat AND p.lon = m.lon LEFT JOIN forecast_daily f ON f.lat = m.clat AND f.lon = m.clon AND f.date = p.date
JOIN rmap q ON p.lat = q.lat AND p.lon = q.lon LEFT JOIN reanalysis_daily r ON r.lat = q.clat AND r.lon = q.clon AND r.date = p.date""",
    "geoscf_pm25 merra2_so4 merra2_pblh_max merra2_pm25_proxy"), "panel", "forecast_daily", "reanalysis_daily",
    fmap=product_map("forecast_daily"), rmap=product_map("reanalysis_daily")))
def external_attach(i):
    src = sources(i)
    df = features.with_external(panel(i), src.forecast, src.reanalysis)
    return df.select("sensor_id", "date", "geoscf_pm25", "merra2_so4", "merra2_pblh_max", "merra2_pm25_proxy")


GRID_SQL = """SELECT (i0 + r)*1.0::DOUBLE AS lat, (j0 + c)*1.0::DOUBLE AS lon, r AS "row", c AS col FROM (
 SELECT floor(MIN(lat) - 1)::BIGINT AS i0, ceil(MAX(lat) + 1)::BIGINT AS i1, floor(MIN(lon) - 1)::BIGINT AS j0, ceil(MAX(lon) + 1)::BIGINT AS j1 FROM tracts),
 range(0, 400) t(r), range(0, 400) u(c) WHERE r <= i1 - i0 AND c <= j1 - j0"""


def coarse_grid(i):
    """One-degree grid over the tract extent (the step is a parameter)."""
    return grid.grid_over(i.tracts, 1.0)


@query("grid_axes", sql(out('SELECT "row", col, lat, lon FROM grid', "lat lon", ""), "tracts", grid=GRID_SQL))
def grid_axes(i):
    return grid.grid_points(i.spark, coarse_grid(i))


@query("nearest_valid_cell_by_channel", sql(out(f"""SELECT date, "row", col, channel, v AS value FROM (
 SELECT c.date, g."row", g.col, c.channel, c.v, row_number() OVER (PARTITION BY c.date, c.channel, g."row", g.col
   ORDER BY {deg('g.lat', 'g.lon', 'c.cell_lat', 'c.cell_lon')}, c.cell_lat, c.cell_lon) AS rn
 FROM grid g CROSS JOIN (SELECT date, cell_lat, cell_lon, unnest(['aod', 'cams_pm25', 'dust']) AS channel, unnest([aod, cams_pm25, dust]) AS v FROM daily_cells) c
 WHERE c.v IS NOT NULL) WHERE rn = 1""", "value"), "tracts", "daily_cells", grid=GRID_SQL))
def nearest_valid_cell_by_channel(i):
    return grid.gridded(i.daily_cells, ["aod", "cams_pm25", "dust"], coarse_grid(i), lat="cell_lat", lon="cell_lon")


@query("idw_to_grid", sql(out(f"""SELECT date, "row", col, channel, SUM(v*w)/SUM(w) AS value FROM (
 SELECT *, 1.0/(greatest(d, 1e-6)*greatest(d, 1e-6)) AS w FROM (SELECT *, row_number() OVER (PARTITION BY date, channel, "row", col ORDER BY d, sensor_id) AS rn FROM (
  SELECT c.date, g."row", g.col, c.channel, c.v, c.sensor_id, {deg('g.lat', 'g.lon', 'c.lat', 'c.lon')} AS d
  FROM grid g CROSS JOIN (SELECT date, sensor_id, lat, lon, unnest(['temperature', 'humidity']) AS channel, unnest([temperature, humidity]) AS v FROM panel) c
  WHERE c.v IS NOT NULL)) WHERE rn <= 8) GROUP BY 1, 2, 3, 4""", "value"), "tracts", "panel", grid=GRID_SQL))
def idw_to_grid(i):
    return grid.gridded(panel(i), ["temperature", "humidity"], coarse_grid(i), k=8, id_col="sensor_id")


SITES = "SELECT DISTINCT site_id, date, lat, lon FROM reference_daily"
SITE_PAIRS = f"""SELECT *, row_number() OVER (PARTITION BY site_id, date ORDER BY d, sensor_id) AS rn FROM (
 SELECT s.site_id, s.date, s.lat, s.lon, p.sensor_id, p.temperature, p.humidity, p.pressure, p.wind_speed, p.precipitation, coalesce(sm.hms_smoke, 0) AS hms,
   {deg('s.lat', 's.lon', 'p.lat', 'p.lon')} AS d
 FROM sites s JOIN panel p ON s.date = p.date LEFT JOIN smoke sm ON TRY_CAST(sm.sensor_id AS BIGINT) = p.sensor_id AND sm.date = p.date)"""


def smoky_pool(i):
    return cut_lineage(features.with_smoke(panel(i), i.smoke))


@query("idw_field_sampling", sql(out("""SELECT site_id, date, SUM(temperature*w)/SUM(w) AS temperature, SUM(humidity*w) / SUM(CASE WHEN humidity IS NOT NULL THEN w END) AS humidity,
 MAX(CASE WHEN rn = 1 THEN hms END)::SMALLINT AS hms_smoke FROM (SELECT *, 1.0/(greatest(d, 1e-6)*greatest(d, 1e-6)) AS w FROM ranked WHERE rn <= 8) GROUP BY 1, 2""", "temperature humidity"),
    "panel", "smoke", "reference_daily", sites=SITES, ranked=SITE_PAIRS))
def idw_field_sampling(i):
    sites = reference_daily(i)
    found = features.sampled_sensor_fields(sites, smoky_pool(i))
    return sites.join(found, ["date", "lat", "lon"]).select("site_id", "date", "temperature", "humidity", "hms_smoke")


TRACT_MAP = f"""SELECT lat, lon, GEOID, traffic_proximity FROM (SELECT s.lat, s.lon, lpad(t.GEOID, 11, '0') AS GEOID, t.traffic_proximity,
 row_number() OVER (PARTITION BY s.lat, s.lon ORDER BY {deg('s.lat', 's.lon', 't.lat', 't.lon')}, lpad(t.GEOID, 11, '0')) AS rn
FROM (SELECT DISTINCT lat, lon FROM reference_daily) s, tracts t) WHERE rn = 1"""


@query("nearest_tract", sql(out("SELECT * FROM tract_map", "lat lon traffic_proximity", ""), "reference_daily", "tracts", tract_map=TRACT_MAP))
def nearest_tract(i):
    return features.nearest_tract(reference_daily(i), i.tracts, ["traffic_proximity"])


@query("nearest_sensor_distance", sql(out(f"""SELECT a.sensor_id, MIN({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS dist_to_nearest_sensor
FROM s a JOIN s b ON a.sensor_id <> b.sensor_id GROUP BY 1""", "dist_to_nearest_sensor", ""), "panel", s="SELECT DISTINCT sensor_id, lat, lon FROM panel"))
def nearest_sensor_distance(i):
    return features.nearest_sensor_distance(panel(i))


@query("site_sensor_distance", sql(out(f"""SELECT a.lat, a.lon, MIN({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS dist_to_nearest_sensor
FROM (SELECT DISTINCT lat, lon FROM reference_daily) a, s b GROUP BY 1, 2""", "lat lon dist_to_nearest_sensor", ""), "panel", "reference_daily", s="SELECT DISTINCT sensor_id, lat, lon FROM panel"))
def site_sensor_distance(i):
    return features.site_sensor_distance(reference_daily(i), panel(i))


@query("attribute_joins", sql(out("""SELECT p.sensor_id, p.date, t.traffic_proximity, t.diesel_pm_proximity, coalesce(s.hms_smoke, 0)::SMALLINT AS hms_smoke,
 coalesce(CASE WHEN p.sensor_id % 2 = 0 AND p.sensor_id % 14 <> 0 THEN (p.sensor_id*7) % 900 + 0.5 END,
   CASE WHEN e.id IS NOT NULL THEN (e.id*11 % 800)::DOUBLE END) AS elevation
FROM panel p LEFT JOIN tracts t ON lpad(t.GEOID, 11, '0') = p.GEOID
LEFT JOIN smoke s ON TRY_CAST(s.sensor_id AS BIGINT) = p.sensor_id AND s.date = p.date
LEFT JOIN (SELECT DISTINCT sensor_id AS id FROM panel WHERE sensor_id % 3 <> 0) e ON e.id = p.sensor_id""",
    "traffic_proximity diesel_pm_proximity elevation"), "panel", "tracts", "smoke"))
def attribute_joins(i):
    elevation = ingest.elevation_maps(i.elevation_documents)
    df = features.with_smoke(features.with_tract_columns(panel(i), i.tracts, C.PROXIMITY_COLUMNS), i.smoke)
    df = features.with_elevation(df, *elevation)
    return df.select("sensor_id", "date", "traffic_proximity", "diesel_pm_proximity", "hms_smoke", "elevation")


@query("training_frame", sql(out("""SELECT n.sensor_id, n.date, n.target, n.nbr_pm25_50km, n.nbr_std_50km, n.nbr_count_100km, c.dust, f.geoscf_pm25, r.merra2_pm25_proxy,
  coalesce(s.hms_smoke, 0)::SMALLINT AS hms_smoke, true AS in_region, 45::BIGINT AS n_features
FROM nbr n JOIN panel p ON n.sensor_id = p.sensor_id AND n.date = p.date
JOIN cell_map m ON p.lat = m.lat AND p.lon = m.lon LEFT JOIN daily_cells c ON c.cell_lat = m.clat AND c.cell_lon = m.clon AND c.date = p.date
JOIN fmap fm ON p.lat = fm.lat AND p.lon = fm.lon LEFT JOIN forecast_daily f ON f.lat = fm.clat AND f.lon = fm.clon AND f.date = p.date
JOIN rmap rm ON p.lat = rm.lat AND p.lon = rm.lon LEFT JOIN reanalysis_daily r ON r.lat = rm.clat AND r.lon = rm.clon AND r.date = p.date
LEFT JOIN smoke s ON TRY_CAST(s.sensor_id AS BIGINT) = p.sensor_id AND s.date = p.date WHERE p.sensor_id % 10 <> 9""",
    "target nbr_pm25_50km nbr_std_50km dust geoscf_pm25 merra2_pm25_proxy"), "panel", "daily_cells", "forecast_daily", "reanalysis_daily", "smoke",
    **NBR_CTES, cell_map=CELL_MAP, fmap=product_map("forecast_daily"), rmap=product_map("reanalysis_daily")))
def training_frame(i):
    df = features.training_frame(panel(i), sources(i))
    n = len(features.feature_columns(df.withColumns({"latitude": F.col("lat"), "longitude": F.col("lon")})))
    return df.select("sensor_id", "date", "target", "nbr_pm25_50km", "nbr_std_50km", "nbr_count_100km", "dust", "geoscf_pm25",
                     "merra2_pm25_proxy", "hms_smoke", "in_region", F.lit(n).cast("long").alias("n_features"))


SITE_NEIGHBORS = f"""SELECT s.site_id, s.date, AVG(p.target) FILTER (d <= 50) AS m50, COUNT(*) FILTER (d <= 50) AS c50, COUNT(*) FILTER (d <= 100) AS c100
FROM (SELECT s.site_id, s.date, p.target, {hav('s.lat', 's.lon', 'p.lat', 'p.lon')} AS d FROM sites s JOIN panel p ON s.date = p.date AND p.target IS NOT NULL) s,
 LATERAL (SELECT s.target) p(target) GROUP BY 1, 2"""


@query("site_features", sql(out("""SELECT s.site_id, s.date, m.temperature, m.temperature*m.humidity/100 AS temp_x_humidity, t.traffic_proximity,
 coalesce(n.m50, (SELECT AVG(target) FROM panel)) AS nbr_pm25_50km, coalesce(n.c50, 0)::INT AS nbr_count_50km, coalesce(n.c100, 0)::INT AS nbr_count_100km, f.geoscf_pm25
FROM sites s LEFT JOIN (SELECT site_id, date, SUM(temperature*w)/SUM(w) AS temperature, SUM(humidity*w) / SUM(CASE WHEN humidity IS NOT NULL THEN w END) AS humidity
   FROM (SELECT *, 1.0/(greatest(d, 1e-6)*greatest(d, 1e-6)) AS w FROM ranked WHERE rn <= 8) GROUP BY 1, 2) m ON s.site_id = m.site_id AND s.date = m.date
LEFT JOIN tract_map t ON s.lat = t.lat AND s.lon = t.lon LEFT JOIN site_nbr n ON s.site_id = n.site_id AND s.date = n.date
JOIN fmap fm ON s.lat = fm.lat AND s.lon = fm.lon LEFT JOIN forecast_daily f ON f.lat = fm.clat AND f.lon = fm.clon AND f.date = s.date""",
    "temperature temp_x_humidity traffic_proximity nbr_pm25_50km geoscf_pm25"), "panel", "smoke", "reference_daily", "tracts", "forecast_daily",
    sites=SITES, ranked=SITE_PAIRS, tract_map=TRACT_MAP, site_nbr=SITE_NEIGHBORS, fmap=product_map("forecast_daily", "reference_daily")))
def site_features(i):
    df = features.site_features(reference_daily(i).drop("pm25_aqs"), smoky_pool(i), sources(i))
    return df.select("site_id", "date", "temperature", "temp_x_humidity", "traffic_proximity", "nbr_pm25_50km", "nbr_count_50km", "nbr_count_100km", "geoscf_pm25")


PIX = """SELECT sensor_id, date, pm25, humidity, r::BIGINT AS "row", c::BIGINT AS col, (r*w + c)::BIGINT AS pixel FROM (
 SELECT p.sensor_id, p.date, p.pm25, p.humidity, round_even((p.lat - round(i0*0.1::DOUBLE, 6))/0.1::DOUBLE, 0)::DOUBLE AS r, round_even((p.lon - round(j0*0.1::DOUBLE, 6))/0.1::DOUBLE, 0)::DOUBLE AS c,
   i1 - i0 + 1 AS h, j1 - j0 + 1 AS w FROM panel p,
 (SELECT floor(MIN(lat)/0.1::DOUBLE - 1)::BIGINT AS i0, ceil(MAX(lat)/0.1::DOUBLE + 1)::BIGINT AS i1, floor(MIN(lon)/0.1::DOUBLE - 1)::BIGINT AS j0, ceil(MAX(lon)/0.1::DOUBLE + 1)::BIGINT AS j1 FROM tracts)
 WHERE p.sensor_id IN (SELECT CAST(sensor_id AS BIGINT) FROM membership WHERE lower(in_tx) = 'true'))
 WHERE r BETWEEN 0 AND h - 1 AND c BETWEEN 0 AND w - 1"""


def fine_grid(i):
    return grid.grid_over(i.tracts, 0.1)


def observed(i):
    return grid.supervision(panel(i), fine_grid(i), ingest.in_region_ids(i.membership))


@query("supervision_filter", sql(out('SELECT sensor_id, date, "row", col, pixel, pm25 FROM pix', "pm25"), "panel", "tracts", "membership", pix=PIX))
def supervision_filter(i):
    return observed(i)


@query("humidity_supervision_join", sql(out("""SELECT sensor_id, date, "row", col, pixel, greatest(0.524*pm25 - 0.0862*humidity + 5.75, 0) AS pm25 FROM pix WHERE humidity IS NOT NULL""",
    "pm25"), "panel", "tracts", "membership", pix=PIX))
def humidity_supervision_join(i):
    return grid.corrected_supervision(observed(i), panel(i))


@query("pixel_day_targets", sql(out('SELECT date, "row", col, AVG(pm25) AS y, COUNT(*) AS n FROM pix GROUP BY 1, 2, 3', "y"), "panel", "tracts", "membership", pix=PIX))
def pixel_day_targets(i):
    return grid.pixel_targets(observed(i))


HELD = """SELECT pixel FROM (SELECT pixel, row_number() OVER (ORDER BY md5('42:' || pixel)) AS rn, COUNT(*) OVER () AS n FROM (SELECT DISTINCT pixel FROM pix))
WHERE rn <= greatest(1, round_even(0.2::DOUBLE*n, 0))"""


@query("held_out_pixels", sql("SELECT pixel FROM held", "panel", "tracts", "membership", pix=PIX, held=HELD))
def held_out_pixels(i):
    return held_out_ids(observed(i), "pixel", 0.2)


@query("held_out_pixel_rows", sql(out('SELECT sensor_id, date, pixel, pm25 FROM pix WHERE pixel IN (SELECT pixel FROM held)', "pm25"), "panel", "tracts", "membership", pix=PIX, held=HELD))
def held_out_pixel_rows(i):
    obs = observed(i)
    return obs.join(held_out_ids(obs, "pixel", 0.2), "pixel", "left_semi").select("sensor_id", "date", "pixel", "pm25")


@query("in_region_rows", sql(out("""SELECT sensor_id, date, pm25 FROM panel WHERE sensor_id NOT IN (SELECT CAST(sensor_id AS BIGINT) FROM membership WHERE lower(in_tx) <> 'true')""", "pm25"), "panel", "membership"))
def in_region_rows(i):
    return panel(i).join(ingest.out_of_region_ids(i.membership), "sensor_id", "left_anti").select("sensor_id", "date", "pm25")


@query("surface_sampling", sql(out("""SELECT a.sensor_id, a.date, b.y AS surface FROM pix a LEFT JOIN (SELECT date, "row", col, AVG(pm25) AS y FROM pix WHERE day(date) % 2 = 0 GROUP BY 1, 2, 3) b
 ON a.date = b.date AND a."row" = b."row" AND a.col = b.col""", "surface"), "panel", "tracts", "membership", pix=PIX))
def surface_sampling(i):
    surface = grid.pixel_targets(observed(i)).filter(F.dayofmonth("date") % 2 == 0)
    rows = panel(i).join(ingest.in_region_ids(i.membership), "sensor_id", "left_semi")
    g = fine_grid(i)
    return (grid.sampled_surface(rows, surface, g, "y").filter("pixel IS NOT NULL").select("sensor_id", "date", "surface"))


@query("lag_graph", sql(out(f"""SELECT sensor_id AS id, date, other AS p_id, rn::INT AS rank, d AS distance FROM (
 SELECT *, row_number() OVER (PARTITION BY sensor_id, date ORDER BY d, other) AS rn FROM pairs) WHERE rn <= 8
 AND sensor_id IN (SELECT sensor_id FROM panel p WHERE p.target IS NOT NULL AND p.date = date)""", "distance"), "panel",
    pairs=PAIRS + " AND a.target IS NOT NULL"))
def lag_graph(i):
    g = metrics.lag_neighbors(panel(i), value="target")
    return g.select("id", "date", "p_id", "rank", "distance")


def baseline_pairs() -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY sensor_id, date ORDER BY d, other) AS rn FROM (
 SELECT a.sensor_id, a.date, b.sensor_id AS other, b.target AS v, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d
 FROM folded a JOIN folded b ON a.date = b.date AND a.fold <> b.fold AND b.target IS NOT NULL)"""


@query("nearest_baseline", sql(out("""SELECT p.sensor_id, p.date, r.v AS nearest FROM panel p LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r
 ON p.sensor_id = r.sensor_id AND p.date = r.date""", "nearest"), "folded", ranked=baseline_pairs()))
def nearest_baseline(i):
    return baselines.nearest_baseline(folded(i))


IDW8 = """SELECT sensor_id, date, SUM(v*w)/SUM(w) AS idw FROM (SELECT *, 1.0/(greatest(d, 1e-3)*greatest(d, 1e-3)) AS w FROM ranked WHERE rn <= 8) GROUP BY 1, 2"""


@query("idw_baseline", sql(out("""SELECT p.sensor_id, p.date, r.idw FROM panel p LEFT JOIN idw8 r ON p.sensor_id = r.sensor_id AND p.date = r.date""", "idw"),
    "folded", ranked=baseline_pairs(), idw8=IDW8))
def idw_baseline(i):
    return baselines.idw_baseline(folded(i))


def variogram_sql() -> str:
    m = variogram.MOMENTS
    cell, sub = f"(side / {variogram.CELLS})", f"(side / {variogram.CELLS * variogram.SUBCELLS})"
    sums = "COUNT(*)::DOUBLE AS n, SUM(v) AS sv, SUM(v*v) AS svv, SUM(x) AS sx, SUM(y) AS sy, SUM(x*x + y*y) AS srr"
    total = ", ".join(f"SUM({c}) AS {c}" for c in m)
    between = """a.date, a.fold, a.n*b.n AS pairs, b.n*a.srr + a.n*b.srr - 2*(a.sx*b.sx + a.sy*b.sy) AS dd,
 0.5::DOUBLE*(b.n*a.svv + a.n*b.svv - 2*a.sv*b.sv) AS g"""
    return sql(out("""SELECT date, fold, bin, sqrt(greatest(SUM(dd), 0)/SUM(pairs)) AS lag, greatest(SUM(g), 0)/SUM(pairs) AS gamma, SUM(pairs) AS pairs
 FROM binned GROUP BY 1, 2, 3""", "lag gamma pairs"), "folded",
        box="""SELECT (MIN(lat) + MAX(lat))/2 AS la, (MIN(lon) + MAX(lon))/2 AS lo,
 greatest(MAX(lat) - MIN(lat), (MAX(lon) - MIN(lon))*cos(radians((MIN(lat) + MAX(lat))/2))) AS side FROM folded""",
        pts="SELECT date, fold, target AS v, lat - la AS y, (lon - lo)*cos(radians(la)) AS x, side FROM folded, box WHERE target IS NOT NULL",
        own=f"""SELECT date, fold, floor((y + side/2)/{cell}) AS ci, floor((x + side/2)/{cell}) AS cj, floor((y + side/2)/{sub}) AS si, floor((x + side/2)/{sub}) AS sj, {sums}
 FROM pts GROUP BY 1, 2, 3, 4, 5, 6""",
        whole=f"SELECT date, ci, cj, si, sj, {total} FROM own GROUP BY 1, 2, 3, 4, 5",
        fine=f"""SELECT * FROM (SELECT w.date, f.fold, w.ci, w.cj, w.si, w.sj, {', '.join(f'w.{c} - coalesce(o.{c}, 0) AS {c}' for c in m)}
 FROM whole w JOIN (SELECT DISTINCT date, fold FROM own) f ON f.date = w.date LEFT JOIN own o ON o.date = w.date AND o.fold = f.fold AND o.si = w.si AND o.sj = w.sj) WHERE n > 0""",
        coarse=f"SELECT date, fold, ci, cj, {total} FROM fine GROUP BY 1, 2, 3, 4",
        every=f"""SELECT {between} FROM coarse a JOIN coarse b ON a.date = b.date AND a.fold = b.fold AND (a.ci < b.ci OR (a.ci = b.ci AND a.cj < b.cj))
 AND greatest(abs(a.ci - b.ci), abs(a.cj - b.cj)) <= {variogram.CELLS // 3 + 1}
 UNION ALL SELECT {between} FROM fine a JOIN fine b ON a.date = b.date AND a.fold = b.fold AND a.ci = b.ci AND a.cj = b.cj AND (a.si < b.si OR (a.si = b.si AND a.sj < b.sj))
 UNION ALL SELECT date, fold, n*(n - 1)/2, n*srr - sx*sx - sy*sy, 0.5::DOUBLE*(n*svv - sv*sv) FROM fine WHERE n > 1""",
        binned=f"""SELECT * FROM (SELECT every.*, CAST(floor(sqrt(greatest(dd, 0)/pairs)/(side/3)*{variogram.LAGS}) AS BIGINT) AS bin FROM every, box) WHERE bin < {variogram.LAGS}""")


@query("variogram_bins", variogram_sql())
def variogram_bins(i):
    return variogram.variogram_bins(folded(i), "target", "fold")


@query("kriging_baseline")
def kriging_baseline(i):
    return kriging.kriging_baseline(folded(i))


@query("residual_kriging")
def residual_kriging(i):
    df = folded(i)
    oof = df.join(baselines.idw_baseline(df), ["sensor_id", "date"])
    return kriging.residual_kriging(oof, "idw")


@query("residual_kriging_to_sites")
def residual_kriging_to_sites(i):
    resid = panel(i).withColumn("residual", F.col("target") - F.col("pm25"))
    return kriging.krige_to_sites(resid, reference_daily(i), default=0.0)


def stacked(i, extended: bool = False):
    src = sources(i)
    elevation = ingest.tract_lookup(i.tracts).join(src.tract_elevation, "GEOID")
    smoke = i.smoke.withColumn("sensor_id", F.col("sensor_id").try_cast("long")).filter("sensor_id IS NOT NULL")
    g = coarse_grid(i)
    return grid.base_stack(panel(i), i.daily_cells, smoke, elevation, g, i.spark, extended,
                           src.forecast if extended else None, src.reanalysis if extended else None), g


@query("channel_stack")
def channel_stack(i):
    stack, _ = stacked(i)
    return stack.groupBy("group", "channel").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("valid"), F.avg("value").alias("mean"))


@query("extended_channel_stack")
def extended_channel_stack(i):
    stack, g = stacked(i, extended=True)
    return (grid.with_flags(stack, g).groupBy("group", "channel")
            .agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("valid"), F.avg("value").alias("mean")))


CELL_STACK = """SELECT date, cell_lat, cell_lon, 'aerosol' AS "group", unnest(['aod', 'cams_pm25', 'dust']) AS channel, unnest([aod, cams_pm25, dust]) AS v FROM daily_cells"""


def cell_stack(i):
    """The daily product's own cells as a channel table (some values NULL)."""
    long = grid.unpivoted(i.daily_cells, ["date", "cell_lat", "cell_lon"], ["aod", "cams_pm25", "dust"])
    return long.withColumn("group", F.lit("aerosol"))


@query("channel_fill", sql(out("""SELECT channel, AVG(v) AS fill, COUNT(*) AS cells, COUNT(*) FILTER (v IS NULL) AS filled FROM cs GROUP BY 1""", "fill", ""), "daily_cells", cs=CELL_STACK))
def channel_fill(i):
    stack = cell_stack(i)
    done = grid.filled(stack).groupBy("channel").agg(F.avg("value").alias("fill"), F.count("value").alias("cells"))
    gaps = stack.groupBy("channel").agg(F.count_if(F.col("value").isNull()).alias("filled"))
    return done.join(gaps, "channel")


@query("channel_statistics", sql(out("""SELECT channel, AVG(v) AS mean, greatest(stddev_pop(v), 1e-6) AS std, AVG(coalesce(v, fill)) AS mean_filled, greatest(stddev_pop(coalesce(v, fill)), 1e-6) AS std_filled
FROM (SELECT *, AVG(v) OVER (PARTITION BY channel) AS fill FROM cs) GROUP BY 1""", "mean std mean_filled std_filled", ""), "daily_cells", cs=CELL_STACK))
def channel_statistics(i):
    stack = cell_stack(i)
    observed_stats = grid.channel_stats(stack, observed_only=True).drop("group")
    after = grid.channel_stats(grid.filled(stack)).select("channel", F.col("mean").alias("mean_filled"), F.col("std").alias("std_filled"))
    return observed_stats.join(after, "channel")


@query("standardised_channels", sql(out("""SELECT date, cell_lat, cell_lon, channel, (coalesce(v, fill) - mean)/std AS value FROM (SELECT *, AVG(coalesce(v, fill)) OVER (PARTITION BY channel) AS mean,
 stddev_pop(coalesce(v, fill)) OVER (PARTITION BY channel) AS std FROM (SELECT *, AVG(v) OVER (PARTITION BY channel) AS fill FROM cs))""", "value"), "daily_cells", cs=CELL_STACK))
def standardised_channels(i):
    full = grid.filled(cell_stack(i))
    return grid.standardised(full, grid.channel_stats(full)).select("date", "cell_lat", "cell_lon", "channel", "value")


@query("availability_flags", sql(out("""SELECT d.date, 'aerosol' AS "group", CASE WHEN c.date IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag
FROM (SELECT DISTINCT date FROM panel) d LEFT JOIN (SELECT DISTINCT date FROM daily_cells) c ON d.date = c.date""", "flag"), "panel", "daily_cells"))
def availability_flags(i):
    g = coarse_grid(i)
    rows = grid.gridded(i.daily_cells, ["aod"], g, lat="cell_lat", lon="cell_lon")
    stack = grid.channel_stack({"aerosol": rows}, {"aerosol": ["aod"]}, panel(i), g)
    return grid.group_flags(stack)


@query("elevation_plane", sql(out(f"""SELECT d.date, "row", col, value FROM (SELECT DISTINCT date FROM panel) d CROSS JOIN (
 SELECT "row", col, SUM(e*w)/SUM(w) AS value FROM (SELECT *, 1.0/(greatest(d, 1e-6)*greatest(d, 1e-6)) AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY d, GEOID) AS rn FROM (
   SELECT g."row", g.col, t.GEOID, t.e, {deg('g.lat', 'g.lon', 't.lat', 't.lon')} AS d FROM grid g CROSS JOIN te t)) WHERE rn <= 4) GROUP BY 1, 2)""", "value"),
    "panel", "tracts", grid=GRID_SQL, te="""SELECT lpad(t.GEOID, 11, '0') AS GEOID, t.lat, t.lon, (CAST(t.GEOID AS BIGINT)*11 % 800)::DOUBLE AS e FROM tracts t
 WHERE CAST(t.GEOID AS BIGINT) IN (SELECT sensor_id FROM panel WHERE sensor_id % 3 <> 0)"""))
def elevation_plane(i):
    elevation = ingest.tract_lookup(i.tracts).join(ingest.elevation_maps(i.elevation_documents)[1], "GEOID")
    g = coarse_grid(i)
    plane = grid.static_plane(elevation, "elevation", g, i.spark)
    return grid.over_days(plane, panel(i), g, "elevation").select("date", "row", "col", "value")


@query("day_selection", sql(out("""SELECT 'smoke' AS role, * FROM (SELECT date, smoke, cams FROM days ORDER BY smoke DESC, cams DESC, date LIMIT 1)
UNION ALL SELECT 'clean', * FROM (SELECT date, smoke, cams FROM days WHERE date <> (SELECT date FROM days ORDER BY smoke DESC, cams DESC, date LIMIT 1) ORDER BY smoke, cams, date LIMIT 1)""", "smoke cams"),
    "panel", "daily_cells", days="""SELECT p.date, coalesce(AVG(n_err), 0)::DOUBLE AS smoke, coalesce(MAX(c.cams), 0) AS cams FROM panel p
 LEFT JOIN (SELECT date, AVG(cams_pm25) AS cams FROM daily_cells GROUP BY 1) c ON p.date = c.date GROUP BY 1"""))
def day_selection(i):
    smoke = panel(i).select("date", F.lit("hms_smoke").alias("channel"), F.col("n_err").cast("double").alias("value"))
    cams = i.daily_cells.select("date", F.lit("cams_pm25").alias("channel"), F.col("cams_pm25").alias("value"))
    return grid.day_selection(smoke.unionByName(cams))


@query("lag_correlation", sql(out("""SELECT lag::INT AS lag, corr(x, y) AS r, COUNT(*) AS n_days FROM (SELECT date, AVG(geoscf_pm25) AS x FROM forecast_daily GROUP BY 1) a
CROSS JOIN range(-3, 4) t(lag) JOIN (SELECT date, AVG(pm25) AS y FROM panel GROUP BY 1) b ON b.date = a.date + lag::INT GROUP BY 1""", "r", ""), "forecast_daily", "panel"))
def lag_correlation(i):
    return ingest.lag_correlation(ingest.forecast_daily(i.hourly_forecast), panel(i), "geoscf_pm25", "pm25")
