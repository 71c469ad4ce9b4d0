"""Readers, writers and contracts over small files."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spatiofuse import constants as C
from spatiofuse.functions import scalar as S
from spatiofuse.operators.grid import Grid, calendar_planes
from spatiofuse.plans.features import ablation_features, feature_columns
from spatiofuse.plans.validate import export_surface
from spatiofuse.sources import ingest, sinks
from spatiofuse.sources.derived import Inputs
from tests.oracle_check import difference

HEADER = ("State Code,County Code,Site Num,Parameter Code,POC,Latitude,Longitude,Date Local,Sample Duration,"
          "Arithmetic Mean,Event Type,Observation Percent\n")


def test_regulatory_files(spark, tmp_path):
    rows = ["48,001,0007,88101,1,30.0,-97.0,2024-01-01,1 HOUR,9.0,,80",
            "48,001,0007,88101,2,30.0,-97.0,2024-01-01,24-HR BLK AVG,7.0,None,10",  # duration beats instrument
            "48,001,0007,88101,2,30.0,-97.0,2024-01-01,24-HR BLK AVG,9.0,None,10",  # copy per standard: averaged
            "48,001,0007,88101,1,30.0,-97.0,2024-01-02,1 HOUR,4.0,,",  # unknown completeness: dropped
            "48,001,0007,88101,1,30.0,-97.0,2024-01-03,24 HOUR,4.0,Excluded,100",
            "06,001,0007,88101,1,30.0,-97.0,2024-01-01,24 HOUR,5.0,,100"]
    (tmp_path / "a.csv").write_text(HEADER + "\n".join(rows) + "\n")
    daily = ingest.regulatory_daily(ingest.regulatory_rows(ingest.read_regulatory_feed(spark, str(tmp_path)))).collect()
    assert [(r.site_id, r.date, r.pm25_aqs) for r in daily] == [("480010007", dt.date(2024, 1, 1), 8.0)]


def test_json_and_geojson_files(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"sensors": {"3": 10.5, "4.0": "7", "x": 1, "5": "bad"}, "tracts": {"00000000001": 2, "2": None}}))
    sensors, tracts = ingest.read_elevations(spark, str(tmp_path / "e.json"))
    assert {tuple(r) for r in sensors.collect()} == {(3, 10.5), (4, 7.0)}
    assert {tuple(r) for r in tracts.collect()} == {("00000000001", 2.0)}
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring, ring]}},
                {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}},
                {"type": "Feature", "geometry": None}]
    (tmp_path / "t.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rings = ingest.read_polygons(spark, str(tmp_path / "t.geojson")).collect()
    assert len(rings) == 3 and all(len(r.ring) == 4 for r in rings)


def test_months(spark):
    bounds = spark.createDataFrame([(dt.date(2024, 1, 15), dt.date(2024, 3, 2))], "start date, end date")
    w = ingest.month_windows(bounds)
    assert [tuple(r) for r in w.orderBy("tag").collect()] == [
        ("202401", dt.date(2024, 1, 15), dt.date(2024, 1, 31)), ("202402", dt.date(2024, 2, 1), dt.date(2024, 2, 29)),
        ("202403", dt.date(2024, 3, 1), dt.date(2024, 3, 2))]
    table = spark.createDataFrame([(dt.date(2024, 2, 5),)], "date date")
    failed = spark.createDataFrame([("202403",)], "tag string")
    assert [r.tag for r in ingest.retry_order(ingest.month_gaps(w, table, failed)).collect()] == ["202403", "202401"]
    assert not ingest.covers_window(table.filter("false"), "2024-01-01", "2024-01-02").first().covers


def test_month_partitioned_write(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, m, 1), float(m)) for m in (1, 2, 2)], "date date, v double")
    ingest.write_by_month(df, str(tmp_path / "m"), ["date", "v"])
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == 3 and {str(r.month) for r in back.select("month").collect()} == {"202401", "202402"}


def test_panel_scan(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 5), float("nan"), 50.0, 30.0, -97.0, 1.0, 1.0, "7"),
            (1, dt.datetime(2024, 1, 2, 5), 4.0, float("nan"), 30.0, -97.0, 1.0, 1.0, "7"),
            (1, dt.datetime(2019, 1, 2, 5), 4.0, 5.0, 30.0, -97.0, 1.0, 1.0, "7")]
    df = spark.createDataFrame(rows, "sensor_id long, date timestamp, pm25 double, humidity double, latitude double, longitude double, lat double, lon double, GEOID string")
    got = S.with_target(ingest.sensor_day_panel(df)).collect()
    assert len(got) == 1 and got[0].lat == 30.0 and got[0].GEOID == "00000000007" and got[0].target is None
    with pytest.raises(ValueError):
        S.with_target(df, "other")


def test_contract(spark):
    df = S.with_missing_columns(spark.range(1), [*C.PHYSICAL_FEATURES, "dust", "geoscf_pm25", *C.REANALYSIS_FEATURES, *C.DEMOGRAPHIC_COLUMNS])
    feats = feature_columns(df)
    assert len(feats) == 45 and not set(feats) & set(C.DEMOGRAPHIC_COLUMNS)
    assert [len(ablation_features(feats, v, C.DEMOGRAPHIC_COLUMNS)) for v in ("primary", "plus_demographics", "no_external", "no_neighbor")] == [45, 49, 35, 38]
    with pytest.raises(ValueError):
        feature_columns(df.drop("humidity"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "k int, r2 double")
    flat = sinks.flat_metrics(df, "s", ["r2"], ["k"])
    text = json.loads(sinks.metrics_json(flat).first().json)
    assert text == {"1.r2": 2.0, "2.r2": None}
    sinks.write_frame(df, str(tmp_path / "f"))
    assert sinks.reload_frame(spark, str(tmp_path / "f"), df, ["k"]).count() == 2
    with pytest.raises(ValueError):
        sinks.reload_frame(spark, str(tmp_path / "f"), df.filter("k = 1"), ["k"])


def test_surface_export(spark, tmp_path):
    g = Grid(0, 0, 2, 3, 0.5)
    dates = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)], "date date")
    surface = calendar_planes(dates, g).filter("channel = 'doy_sin'").select("date", "row", "col", F.col("value").alias("pm25"))
    m = export_surface(surface, g, str(tmp_path / "surface"))
    r = m.first()
    assert (r.n_days, r.n_values, r.height, r.width, r.lat_max, r.lon_max) == (2, 12, 2, 3, 0.5, 1.0)


def test_metrics_json_holds_every_metric(spark):
    flat = spark.createDataFrame([("s", f"m{i:03d}", float(i)) for i in range(400)], "section string, metric string, value double")
    assert len(json.loads(sinks.metrics_json(flat).first().json)) == 400 and sinks.summary_rows(flat).count() == 400


def test_documents_are_one_file_each(spark, tmp_path):
    """Parts of a union that are dealt by the file already still meet in one file."""
    i = Inputs(spark, "/root/testdata/sf0.1")
    for name, lines in (("tracts", i.tract_lines()), ("elevations", i.elevation_lines())):
        sinks.write_documents(lines, str(tmp_path / name))
        assert sorted(len(list(f.glob("*.txt"))) for f in (tmp_path / name).glob("file=*")) == [1, 1, 1, 1]


@pytest.mark.parametrize("name", ["regulatory_daily", "regulatory_quality_filter", "second_tier_merge", "site_sensor_distance"])
def test_long_site_numbers_match_sql(spark, folder, tmp_path, name):
    """Site numbers of over four digits stay whole in the SQL too; 1044 and 10442 share a county and four digits."""
    key = F.when(F.col("l_suppkey") % 3 == 0, 1044).when(F.col("l_suppkey") % 3 == 1, 10442).otherwise(F.col("l_suppkey") + 10_000)
    spark.read.parquet(f"{folder}/lineitem.parquet").withColumn("l_suppkey", key.cast("long")).write.parquet(str(tmp_path / "lineitem.parquet"))
    (tmp_path / "events.parquet").symlink_to(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert difference(entry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(entry.oracle_sql()[name]).df()) is None
