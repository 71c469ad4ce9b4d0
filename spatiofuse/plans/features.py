"""Feature assembly: sensor-day training frame and the same features at arbitrary site-days."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatiofuse import constants as C
from spatiofuse.functions import scalar as S
from spatiofuse.functions.ordering import first_per_key
from spatiofuse.operators.nearest import idw, nearest, nearest_cells, nearest_other, with_nearest_cell
from spatiofuse.operators.neighbors import with_neighbor_features
from spatiofuse.session import cut_lineage
from spatiofuse.sources import ingest


@dataclass
class Sources:
    """Input tables of feature assembly; optional ones may be None."""

    tracts: DataFrame | None = None
    smoke: DataFrame | None = None
    aerosol: DataFrame | None = None
    sensor_elevation: DataFrame | None = None
    tract_elevation: DataFrame | None = None
    forecast: DataFrame | None = None
    reanalysis: DataFrame | None = None
    membership: DataFrame | None = None


def with_tract_columns(df: DataFrame, tracts: DataFrame, columns: list[str]) -> DataFrame:
    """Left-join the missing tract attributes on the padded tract id."""
    wanted = [c for c in columns if c not in df.columns and c in tracts.columns]
    if not wanted:
        return df
    lookup = first_per_key(ingest.tract_lookup(tracts).select("GEOID", *wanted), ["GEOID"], [F.col(wanted[0])])
    return df.join(lookup, "GEOID", "left")


def with_smoke(df: DataFrame, smoke: DataFrame) -> DataFrame:
    """Smoke tier of the sensor-day; no row means 0, ids that do not parse are skipped."""
    tiers = (smoke.select(F.col("sensor_id").try_cast("long").alias("sensor_id"), F.to_date("date").alias("date"), "hms_smoke")
             .filter("sensor_id IS NOT NULL"))
    one = first_per_key(tiers, ["sensor_id", "date"], ["hms_smoke"])
    return (df.join(one, ["sensor_id", "date"], "left")
            .withColumn("hms_smoke", F.coalesce("hms_smoke", F.lit(0)).cast("short")))


def with_elevation(df: DataFrame, sensor_elevation: DataFrame, tract_elevation: DataFrame) -> DataFrame:
    """Surveyed sensor elevation, else that of its tract."""
    by_sensor = sensor_elevation.withColumnRenamed("elevation", "_se")
    by_tract = tract_elevation.withColumnRenamed("elevation", "_te")
    return (df.join(by_sensor, "sensor_id", "left").join(by_tract, "GEOID", "left")
            .withColumn("elevation", F.coalesce("_se", "_te")).drop("_se", "_te"))


def sensor_sites(panel: DataFrame) -> DataFrame:
    """One row per sensor: its first coordinates by date."""
    return panel.groupBy("sensor_id").agg(
        F.min_by("lat", F.struct("date", "lat", "lon")).alias("lat"), F.min_by("lon", F.struct("date", "lat", "lon")).alias("lon"))


def nearest_sensor_distance(panel: DataFrame) -> DataFrame:
    """(sensor_id, dist_to_nearest_sensor) over distinct sensor sites, in km."""
    found = nearest_other(sensor_sites(panel), 1, on=(), id_col="sensor_id")
    return found.select(F.col("id").alias("sensor_id"), F.col("distance").alias("dist_to_nearest_sensor"))


def product_cells(sites: DataFrame, src: Sources) -> dict[str, DataFrame]:
    """Nearest cell of every gridded product to each distinct site, from one join: (lat, lon, clat, clon) by product."""
    products = {"aerosol": (src.aerosol, "cell_lat", "cell_lon"), "forecast": (src.forecast, "lat", "lon"), "reanalysis": (src.reanalysis, "lat", "lon")}
    products = {name: p for name, p in products.items() if p[0] is not None}
    if not products:
        return {}
    found = nearest_cells(sites, products)
    return {name: found.filter(F.col("product") == name).drop("product") for name in products}


def with_external(df: DataFrame, forecast: DataFrame | None, reanalysis: DataFrame | None,
                  cells: dict[str, DataFrame] | None = None) -> DataFrame:
    """Attach optional gridded products; a missing product or column gives NULL columns."""
    cells = product_cells(df, Sources(forecast=forecast, reanalysis=reanalysis)) if cells is None else cells
    for name, product, columns in (("forecast", forecast, C.FORECAST_FEATURES), ("reanalysis", reanalysis, C.REANALYSIS_FEATURES)):
        if product is not None:
            df = S.with_missing_columns(with_nearest_cell(df, product, columns, mapped=cells[name]), columns)
    return df


def sensor_day_features(panel: DataFrame, src: Sources, cells: dict[str, DataFrame] | None = None) -> DataFrame:
    """Every static feature of the panel; columns already present are kept as they are."""
    df = panel
    cells = product_cells(panel, src) if cells is None else cells
    if src.tracts is not None and "GEOID" in df.columns:
        df = with_tract_columns(df, src.tracts, C.PROXIMITY_COLUMNS)
    df = S.with_interactions(S.with_calendar(df))
    if "dist_to_nearest_sensor" not in df.columns:
        df = df.join(nearest_sensor_distance(panel), "sensor_id", "left")
    if "dist_to_coast" not in df.columns:
        df = df.withColumn("dist_to_coast", S.distance_to_points("lat", "lon"))
    if "hms_smoke" not in df.columns and src.smoke is not None:
        df = with_smoke(df, src.smoke)
    df = df.withColumn("hms_smoke", F.coalesce(F.col("hms_smoke"), F.lit(0)).cast("short")
                       if "hms_smoke" in df.columns else F.lit(0).cast("short"))
    if src.aerosol is not None:
        df = with_nearest_cell(df, src.aerosol, ["aod", "cams_pm25", "dust"], "cell_lat", "cell_lon", mapped=cells["aerosol"])
    if "elevation" not in df.columns:
        if src.sensor_elevation is not None:
            df = with_elevation(df, src.sensor_elevation, src.tract_elevation)
        else:
            df = df.withColumn("elevation", F.lit(None).cast("double"))
    return S.with_missing_columns(df, [f for f in C.PHYSICAL_FEATURES if not f.startswith("nbr_")])


def feature_columns(df: DataFrame) -> list[str]:
    """Ordered model inputs; raises on a missing physical feature or a banned one."""
    missing = [f for f in C.PHYSICAL_FEATURES if f not in df.columns]
    if missing:
        raise ValueError(f"frame is missing physical features: {missing}")
    optional = [*C.EXTRA_FEATURES, *C.FORECAST_FEATURES, *C.REANALYSIS_FEATURES]
    feats = [*C.PHYSICAL_FEATURES, *[c for c in optional if c in df.columns]]
    banned = [c for c in feats if c in C.DEMOGRAPHIC_COLUMNS]
    if banned:
        raise ValueError(f"demographic columns must not be model inputs: {banned}")
    return feats


def training_frame(panel: DataFrame, src: Sources, correction: str = "corrected", in_region_only: bool = True,
                   keep_demographics: bool = False) -> DataFrame:
    """Target, static features, neighbours, external products, then the region filter.

    Out-of-region sensors serve as neighbours before they are dropped as targets.
    """
    base = cut_lineage(S.with_target(panel, correction))  # read several times below
    cells = product_cells(base, src)
    df = sensor_day_features(base, src, cells)
    around = with_neighbor_features(base.select("sensor_id", "date", "lat", "lon", "target"))
    df = df.join(around.select("sensor_id", "date", *C.NEIGHBOR_COLUMNS), ["sensor_id", "date"])
    df = with_external(df, src.forecast, src.reanalysis, cells)
    if src.membership is not None:
        outside = ingest.out_of_region_ids(src.membership)
        if in_region_only:
            df = df.join(outside, "sensor_id", "left_anti").withColumn("in_region", F.lit(True))
        else:
            df = (df.join(outside.withColumn("_out", F.lit(True)), "sensor_id", "left")
                  .withColumn("in_region", F.col("_out").isNull()).drop("_out"))
    else:
        df = df.withColumn("in_region", F.lit(True))
    keep = ["sensor_id", "date", "lat", "lon", "target", "pm25", "GEOID", "elevation", "in_region"]
    keep += [f for f in feature_columns(df) if f not in keep]
    if keep_demographics:
        keep += [c for c in C.DEMOGRAPHIC_COLUMNS if c in df.columns and c not in keep]
    return df.select(*keep)


# Site-days -----------------------------------------------------------------

def sampled_sensor_fields(sites: DataFrame, pool: DataFrame, k: int = 8) -> DataFrame:
    """Same-day meteorology (IDW of the k nearest sensors, degree space) and smoke tier of the nearest one.

    Returns (date, lat, lon, meteorology, hms_smoke). A NULL reading among the k
    weighs nothing; the k are chosen regardless of NULLs.
    """
    payload = pool.select("date", "lat", "lon", F.col("sensor_id").alias("id"), *C.MET_COLUMNS, "hms_smoke")
    found = nearest(sites.select("date", "lat", "lon").distinct(), payload, k, metric="degree")
    return found.groupBy("date", "lat", "lon").agg(
        *[idw(found, [], f"p_{c}", 1e-6).alias(c) for c in C.MET_COLUMNS],
        F.min_by("p_hms_smoke", "rank").alias("hms_smoke"))


def nearest_tract(sites: DataFrame, tracts: DataFrame, columns: list[str]) -> DataFrame:
    """(lat, lon, GEOID, columns) of the nearest tract centroid in degree space."""
    lookup = ingest.tract_lookup(tracts).select("lat", "lon", F.col("GEOID").alias("id"), *columns)
    found = nearest(sites.select("lat", "lon").distinct(), lookup, 1, on=(), metric="degree")
    return found.select("lat", "lon", F.col("p_id").alias("GEOID"), *[F.col(f"p_{c}").alias(c) for c in columns])


def site_sensor_distance(sites: DataFrame, panel: DataFrame) -> DataFrame:
    """(lat, lon, dist_to_nearest_sensor): exact nearest sensor site in km."""
    sensors = sensor_sites(panel).select("lat", "lon", F.col("sensor_id").alias("id"))
    found = nearest(sites.select("lat", "lon").distinct(), sensors, 1, on=())
    return found.select("lat", "lon", F.col("distance").alias("dist_to_nearest_sensor"))


def site_features(sites: DataFrame, pool: DataFrame, src: Sources) -> DataFrame:
    """The training features at arbitrary (site_id, date, lat, lon), from sensors and products only.

    One row per (site_id, date). ``pool`` is the sensor-day panel with ``target`` and ``hms_smoke``; a site never
    has a reading of its own, so its id can collide with no sensor's.
    """
    s = ingest.canonical_coordinates(sites.withColumn("date", F.to_date("date")))
    s = cut_lineage(s.withColumn("sensor_id", F.concat(F.lit("site_"), F.col("site_id").cast("string"))))
    places = cut_lineage(s.select("lat", "lon").distinct())
    cells = product_cells(places, src)
    base = s.select("sensor_id", "date", "lat", "lon")
    s = s.join(sampled_sensor_fields(base, pool), ["date", "lat", "lon"], "left")
    s = s.withColumn("hms_smoke", F.coalesce("hms_smoke", F.lit(0)).cast("short"))
    if src.aerosol is not None:
        s = with_nearest_cell(s, src.aerosol, ["aod", "cams_pm25", "dust"], "cell_lat", "cell_lon", mapped=cells["aerosol"])
    if src.tracts is not None:
        s = s.join(nearest_tract(places, src.tracts, C.PROXIMITY_COLUMNS), ["lat", "lon"], "left")
        if src.tract_elevation is not None:
            s = s.join(src.tract_elevation, "GEOID", "left")
    s = s.join(site_sensor_distance(places, pool), ["lat", "lon"], "left")
    s = s.withColumn("dist_to_coast", S.distance_to_points("lat", "lon"))
    s = S.with_interactions(S.with_calendar(s))
    around = with_neighbor_features(base, pool, "target")
    s = s.join(around.select("sensor_id", "date", *C.NEIGHBOR_COLUMNS), ["sensor_id", "date"])
    s = with_external(s, src.forecast, src.reanalysis, cells)
    return S.with_missing_columns(s, C.PHYSICAL_FEATURES)


def feature_coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """Features with any NULL and their non-NULL share, lowest first."""
    one = df.agg(*[(F.count(f) / F.count(F.lit(1))).alias(f) for f in features])
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("coverage")) for f in features])
    return (one.select(F.explode(entries).alias("e")).select("e.feature", "e.coverage")
            .filter("coverage < 1.0").orderBy("coverage", "feature"))


def ablation_features(features: list[str], variant: str, demographics: list[str] | None = None) -> list[str]:
    """Feature list of an ablation variant."""
    if variant == "primary":
        return list(features)
    if variant == "plus_demographics":
        return [*features, *(demographics or [])]
    if variant == "no_external":
        return [f for f in features if not f.startswith(("geoscf_", "merra2_"))]
    if variant == "no_neighbor":
        return [f for f in features if not f.startswith("nbr_")]
    raise ValueError(f"unknown variant {variant!r}")
