"""The derived inputs of ``sources.derived`` as SQL common table expressions."""


def padded(x: str, width: int) -> str:
    """Left-padded with zeros; longer text is kept whole (``lpad`` alone would cut it)."""
    return f"CASE WHEN length({x}) < {width} THEN lpad({x}, {width}, '0') ELSE {x} END"


SITE_ID = f"'48' || {padded('county_code', 3)} || {padded('site_num', 4)}"

CTE = {
    "readings": """
SELECT event_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, user_id AS sensor_id,
       CAST(ts AS DATE) AS date,
       [2970,3278,2942,3027,3169,2590][(user_id % 6 + 1)::INT]/100.0 + ((user_id*37)%121-60)/100.0 + (user_id%7)/1000.0 AS latitude,
       [-9540,-9680,-9850,-9770,-10640,-9750][(user_id % 6 + 1)::INT]/100.0 + ((user_id*53)%131-65)/100.0 + (user_id%11)/1000.0 AS longitude
FROM events""",
    "sensor_days": """
SELECT sensor_id, date, pm25,
       CASE WHEN (sensor_id + dayofyear(date)) % 29 <> 0 THEN rh END AS humidity,
       (10 + (sensor_id*13 + dayofyear(date)*7) % 25)::DOUBLE AS temperature,
       (990 + (sensor_id*7 + dayofyear(date)*3) % 40)::DOUBLE AS pressure,
       ((sensor_id*11 + dayofyear(date)*5) % 12)::DOUBLE AS wind_speed,
       ((sensor_id*3 + dayofyear(date)*17) % 9)::DOUBLE AS precipitation,
       latitude, longitude, CAST(sensor_id AS VARCHAR) AS GEOID, n, n_err
FROM (SELECT sensor_id, date, round(AVG(value) + 1.3e-9, 6) AS pm25, round(AVG(k) + 1.3e-9, 6) AS rh, COUNT(*) AS n,
             COUNT(*) FILTER (event_type = 'error') AS n_err,
             MIN(latitude) AS latitude, MIN(longitude) AS longitude
      FROM readings GROUP BY 1, 2)""",
    "smoke": """
SELECT CASE WHEN sensor_id % 50 = 7 THEN 'x' || sensor_id ELSE CAST(sensor_id AS VARCHAR) END AS sensor_id,
       date, least(3, n_err)::SMALLINT AS hms_smoke
FROM sensor_days WHERE n_err > 0""",
    "daily_cells": """
SELECT i*0.5 + 0.25 AS cell_lat, j*0.5 + 0.25 AS cell_lon, date, round(k/100.0 + 1.3e-9, 6) AS aod, round(v + 1.3e-9, 6) AS cams_pm25,
       CASE WHEN (abs(i + j) + day(date)) % 5 <> 0 THEN round(k*0.3::DOUBLE + 1.3e-9, 6) END AS dust,
       round(v*2.0::DOUBLE + 1.3e-9, 6) AS shortwave, round(k/20.0 + 1.3e-9, 6) AS et0, round(k + 1.3e-9, 6) AS cloud_cover
FROM (SELECT floor(latitude/0.5::DOUBLE)::BIGINT::DOUBLE AS i, floor(longitude/0.5::DOUBLE)::BIGINT::DOUBLE AS j, date, AVG(k) AS k, AVG(value) AS v
      FROM readings WHERE date <> DATE '2024-01-05' GROUP BY 1, 2, 3)""",
    "hourly_forecast": """
SELECT date_trunc('hour', ts) AS time, floor(latitude/0.25::DOUBLE)*0.25::DOUBLE + 0.125::DOUBLE AS lat,
       floor(longitude/0.25::DOUBLE)*0.25::DOUBLE + 0.125::DOUBLE AS lon,
       CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END AS lev,
       CASE WHEN event_id % 13 <> 0 THEN value END AS pm25_rh35_gcc
FROM readings""",
    "hourly_species": """
SELECT date_trunc('hour', ts) AS time, floor(latitude/0.5::DOUBLE)*0.5::DOUBLE + 0.25::DOUBLE AS lat,
       floor(longitude/0.625::DOUBLE)*0.625::DOUBLE + 0.3125::DOUBLE AS lon,
       value*1e-9 AS DUSMASS25, k*1e-9 AS OCSMASS, (event_id % 17)*1e-9 AS BCSMASS,
       CASE WHEN event_id % 11 <> 0 THEN (event_id % 23)*1e-9 END AS SO4SMASS, (event_id % 5)*1e-9 AS SSSMASS25
FROM readings""",
    "hourly_boundary_layer": """
SELECT date_trunc('hour', ts) AS time, floor(latitude/0.5::DOUBLE)*0.5::DOUBLE + 0.25::DOUBLE AS lat,
       floor(longitude/0.625::DOUBLE)*0.625::DOUBLE + 0.3125::DOUBLE AS lon, 200.0 + k*10.0 AS PBLH
FROM readings WHERE event_id % 7 <> 0""",
    "tracts": """
SELECT CAST(c_custkey AS VARCHAR) AS GEOID, (2590 + (c_custkey*7919) % 1060)/100.0 AS lat,
       (-10660 + (c_custkey*104729) % 1300)/100.0 AS lon,
       (c_custkey*17) % 1000/10.0 AS traffic_proximity, (c_custkey*19) % 1000/10.0 AS superfund_proximity,
       (c_custkey*23) % 1000/10.0 AS rmp_proximity, (c_custkey*29) % 1000/10.0 AS diesel_pm_proximity,
       (c_custkey*31) % 100/100.0 AS ejf_score, (c_custkey*37) % 100/100.0 AS pct_people_of_color,
       (c_custkey*41) % 100/100.0 AS pct_low_income, (c_custkey*43) % 100/100.0 AS pct_ling_isolated
FROM customer""",
    "membership": """
SELECT CAST(sensor_id AS VARCHAR) AS sensor_id, CASE WHEN sensor_id % 10 = 9 THEN 'False' ELSE 'True' END AS in_tx
FROM (SELECT DISTINCT sensor_id FROM sensor_days) WHERE sensor_id % 10 <> 8""",
    "reference_feed": """
SELECT CASE WHEN l_suppkey % 5 = 0 THEN '6' ELSE '48' END AS state_code, CAST(l_suppkey % 254 AS VARCHAR) AS county_code,
       CAST(l_suppkey AS VARCHAR) AS site_num, CASE WHEN l_tax >= 0.08 THEN 88502 ELSE 88101 END AS parameter_code,
       l_linenumber AS poc, (2600 + (l_suppkey*37) % 1000)/100.0 AS latitude, (-10600 + (l_suppkey*53) % 1200)/100.0 AS longitude,
       DATE '2024-01-01' + (l_orderkey % 30)::INT AS date,
       CASE l_returnflag WHEN 'A' THEN '24-HR BLK AVG' WHEN 'N' THEN '1 HOUR' ELSE '24 HOUR' END AS duration,
       l_quantity AS mean, CASE WHEN l_linestatus = 'O' AND l_linenumber % 3 = 0 THEN 'Excluded'
                                WHEN l_linenumber % 2 = 0 THEN 'None' END AS event_type,
       CASE WHEN l_partkey % 19 <> 0 THEN (50 + l_partkey % 51)::DOUBLE END AS percent
FROM lineitem""",
    # Cleaned panel: window, target, canonical coordinates.
    "panel": """
SELECT sensor_id, date, pm25, humidity, temperature, pressure, wind_speed, precipitation, latitude AS lat, longitude AS lon,
       CASE WHEN length(GEOID) < 11 THEN lpad(GEOID, 11, '0') ELSE GEOID END AS GEOID, n_err,
       greatest(0.524*pm25 - 0.0862*humidity + 5.75, 0.0) + 0*humidity AS target
FROM sensor_days WHERE pm25 IS NOT NULL AND date BETWEEN DATE '2021-01-01' AND DATE '2026-05-01'""",
    "reference_daily": f"""
SELECT site_id, date, pm25_aqs, lat, lon FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, date ORDER BY dur_rank, poc) AS rn FROM (
    SELECT {SITE_ID} AS site_id, date, poc,
           CASE duration WHEN '24-HR BLK AVG' THEN 0 WHEN '1 HOUR' THEN 1 ELSE 2 END AS dur_rank,
           AVG(mean) AS pm25_aqs, MIN(latitude) AS lat, MIN(longitude) AS lon
    FROM reference_feed
    WHERE state_code = '48' AND parameter_code = 88101 AND event_type IS DISTINCT FROM 'Excluded'
      AND (duration IN ('24-HR BLK AVG', '24 HOUR') OR coalesce(percent >= 75, false))
    GROUP BY 1, 2, 3, 4)) WHERE rn = 1""",
    "forecast_daily": """
SELECT CAST(time AS DATE) AS date, lat, lon, AVG(pm25_rh35_gcc) AS geoscf_pm25 FROM hourly_forecast
WHERE lev = 0 AND lat BETWEEN 25.6 AND 36.7 AND lon BETWEEN -107.0 AND -93.3
GROUP BY 1, 2, 3 HAVING AVG(pm25_rh35_gcc) IS NOT NULL""",
    "reanalysis_daily": """
SELECT a.date, a.lat, a.lon, du AS merra2_dust25, oc AS merra2_oc, bc AS merra2_bc, so4 AS merra2_so4, ss AS merra2_ss25,
       pblh AS merra2_pblh, pblh_max AS merra2_pblh_max, pblh_min AS merra2_pblh_min,
       1.375*so4 + 1.6*oc + bc + du + ss AS merra2_pm25_proxy
FROM (SELECT CAST(time AS DATE) AS date, lat, lon, AVG(DUSMASS25)*1e9 AS du, AVG(OCSMASS)*1e9 AS oc, AVG(BCSMASS)*1e9 AS bc,
             AVG(SO4SMASS)*1e9 AS so4, AVG(SSSMASS25)*1e9 AS ss
      FROM hourly_species WHERE lat BETWEEN 25.6 AND 36.7 AND lon BETWEEN -107.0 AND -93.3 GROUP BY 1, 2, 3) a
JOIN (SELECT CAST(time AS DATE) AS date, lat, lon, AVG(PBLH) AS pblh, MAX(PBLH) AS pblh_max, MIN(PBLH) AS pblh_min
      FROM hourly_boundary_layer WHERE lat BETWEEN 25.6 AND 36.7 AND lon BETWEEN -107.0 AND -93.3 GROUP BY 1, 2, 3) b
  ON a.date = b.date AND a.lat = b.lat AND a.lon = b.lon
WHERE so4 IS NOT NULL AND oc IS NOT NULL AND bc IS NOT NULL AND du IS NOT NULL AND ss IS NOT NULL""",
    # Seeded grouped folds over sensors: near-equal parts of the shuffled ids.
    "folds": """
SELECT sensor_id, ntile(10) OVER (ORDER BY md5('42:' || sensor_id)) - 1 AS fold
FROM (SELECT DISTINCT sensor_id FROM panel)""",
    "folded": "SELECT p.*, f.fold FROM panel p JOIN folds f USING (sensor_id)",
}

NEEDS = {
    "sensor_days": ["readings"], "smoke": ["sensor_days"], "daily_cells": ["readings"],
    "hourly_forecast": ["readings"], "hourly_species": ["readings"], "hourly_boundary_layer": ["readings"],
    "membership": ["sensor_days"], "panel": ["sensor_days"], "reference_daily": ["reference_feed"],
    "forecast_daily": ["hourly_forecast"], "reanalysis_daily": ["hourly_species", "hourly_boundary_layer"],
    "folds": ["panel"], "folded": ["panel", "folds"],
}


def sql(body: str, *names: str, **extra: str) -> str:
    """``body`` with the named inputs (and what they need) in front; ``extra`` are more CTEs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTE[n].strip()})" for n in order] + [f"{n} AS ({t.strip()})" for n, t in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def hav(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    s_lat = f"sin((radians({b_lat})-radians({a_lat}))/2.0)"
    s_lon = f"sin((radians({b_lon})-radians({a_lon}))/2.0)"
    return (f"12742.0*asin(sqrt(least(greatest({s_lat}*{s_lat}"
            f"+cos(radians({a_lat}))*cos(radians({b_lat}))*{s_lon}*{s_lon},0.0),1.0)))")


def deg(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    dy, dx = f"({b_lat}-{a_lat})", f"({b_lon}-{a_lon})"
    return f"sqrt({dy}*{dy}+{dx}*{dx})"


def out(body: str, doubles: str = "", dates: str = "date") -> str:
    """Round the named doubles to six places and give dates as ISO text."""
    parts = [f"round({c} + 1.3e-9, 6) AS {c}" for c in doubles.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    inner = body.strip()
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({inner})" if parts else inner
