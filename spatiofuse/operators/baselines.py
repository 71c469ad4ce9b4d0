"""Out-of-fold spatial baselines: same-day training-fold sensors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatiofuse.operators.nearest import nearest_lists
from spatiofuse.session import cut_lineage


def fold_neighbors(frame: DataFrame, k: int, value: str = "target", fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Keyed rows and a list of the ``k`` nearest same-day readings of another fold for each probe (one join for all folds)."""
    frame = cut_lineage(frame.select("sensor_id", "date", "lat", "lon", fold, value))  # read by several steps
    pool = (frame.filter(F.col(value).isNotNull())
            .select("date", "lat", "lon", F.col("sensor_id").alias("id"), F.col(fold).alias("fold"), F.col(value).alias("v")))
    rows = frame.select("sensor_id", "date", "lat", "lon", F.col(fold).alias("fold"))
    return rows, nearest_lists(rows.select("date", "lat", "lon", "fold").distinct(), pool, k, not_same="fold")


def spatial_baselines(frame: DataFrame, k: int = 8, value: str = "target", fold: str = "fold") -> DataFrame:
    """(sensor_id, date, nearest, idw): both baselines from one join; the nearest is the first of the ``k``."""
    rows, found = fold_neighbors(frame, k, value, fold)
    keys = ["date", "lat", "lon", "fold"]
    weights = F.transform("_near", lambda e: F.lit(1.0) / F.pow(F.greatest(e["distance"], F.lit(1e-3)), F.lit(2.0)))
    total = F.aggregate(F.zip_with("_near", "_w", lambda e, w: w * e["p_v"]), F.lit(0.0), lambda a, x: a + x)
    found = found.filter(F.size("_near") > 0).withColumn("_w", weights)
    values = found.select(*keys, F.col("_near")[0]["p_v"].alias("nearest"), (total / F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)).alias("idw"))
    return rows.join(values, keys, "left").select("sensor_id", "date", "nearest", "idw")


def nearest_baseline(frame: DataFrame, value: str = "target", fold: str = "fold") -> DataFrame:
    """(sensor_id, date, nearest): value of the nearest same-day sensor of another fold."""
    return spatial_baselines(frame, 1, value, fold).drop("idw")


def idw_baseline(frame: DataFrame, k: int = 8, value: str = "target", fold: str = "fold") -> DataFrame:
    """(sensor_id, date, idw): inverse-distance-squared mean of the k nearest."""
    return spatial_baselines(frame, k, value, fold).drop("nearest")
