"""Fold assignment and splits, keyed (never positional) and seeded by hash order."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spatiofuse import constants as C
from spatiofuse.functions.ordering import shuffle_key, whole_rank


def dealt_parts(ids: DataFrame, key: str, n: int, seed, out: str = "fold") -> DataFrame:
    """Deal distinct ids, in seeded order, into ``n`` near-equal consecutive parts (first ones larger).

    ``n`` is capped at the number of ids.
    """
    ranked = whole_rank(ids.select(key).distinct().withColumn("_key", shuffle_key(seed, key)), "_key").drop("_key")
    total = ids.select(F.count_distinct(key)).scalar()
    parts = F.least(F.lit(n).cast("long"), total)
    base, extra = F.floor(total / parts), total % parts
    edge = extra * (base + 1)
    i = F.col("rn") - 1
    part = F.when(i < edge, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - edge) / base))
    return ranked.withColumn(out, part.cast("int")).drop("rn")


def sensor_folds(frame: DataFrame, n: int = C.SENSOR_FOLDS, seed=42) -> DataFrame:
    """(sensor_id, fold): every sensor's rows fall in exactly one fold."""
    return dealt_parts(frame, "sensor_id", n, seed)


def with_sensor_folds(frame: DataFrame, n: int = C.SENSOR_FOLDS, seed=42) -> DataFrame:
    return frame.join(sensor_folds(frame, n, seed), "sensor_id")


def block_folds(frame: DataFrame, n_blocks: int = C.BLOCK_FOLDS, seed: int = 42, tries: int = 10) -> DataFrame:
    """(sensor_id, lat, lon, block): k-means regions of the sensors' mean coordinates, best of ``tries``."""
    sites = frame.groupBy("sensor_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    features = VectorAssembler(inputCols=["lat", "lon"], outputCol="features").transform(sites).cache()
    k = min(n_blocks, features.count())
    fitted = [KMeans(k=k, seed=seed + t, maxIter=50).fit(features) for t in range(tries)]
    best = min(fitted, key=lambda m: m.summary.trainingCost)
    out = best.transform(features).select("sensor_id", "lat", "lon", F.col("prediction").alias("block"))
    features.unpersist()
    return out


def temporal_flag(frame: DataFrame, cutoff: str = C.TEMPORAL_CUTOFF) -> DataFrame:
    return frame.withColumn("is_test", F.col("date") >= F.lit(cutoff).cast("date"))


def held_out_ids(ids: DataFrame, key: str, fraction: float, seed=42) -> DataFrame:
    """Seeded share of the distinct ids, at least one (half-to-even rounding)."""
    ranked = whole_rank(ids.select(key).distinct().withColumn("_key", shuffle_key(seed, key)), "_key").drop("_key")
    total = ids.select(F.count_distinct(key)).scalar()
    take = F.greatest(F.lit(1.0), F.rint(F.lit(fraction) * total))
    return ranked.filter(F.col("rn") <= take).select(key)


def calibration_flag(frame: DataFrame, fraction: float = 0.25, seed=42) -> DataFrame:
    """Mark the rows of the calibration sensors (sensor-disjoint from the rest)."""
    chosen = held_out_ids(frame, "sensor_id", fraction, seed).withColumn("is_cal", F.lit(True))
    return frame.join(chosen, "sensor_id", "left").withColumn("is_cal", F.coalesce("is_cal", F.lit(False)))


def frozen_folds(frame: DataFrame, n: int = C.SENSOR_FOLDS, n_blocks: int = C.BLOCK_FOLDS,
                 cutoff: str = C.TEMPORAL_CUTOFF, seed: int = 42) -> DataFrame:
    """All assignments in one table: (sensor_id, date, fold, block, is_test)."""
    keyed = temporal_flag(frame.select("sensor_id", "date"), cutoff)
    blocks = block_folds(frame, n_blocks, seed).select("sensor_id", "block")
    return keyed.join(sensor_folds(frame, n, seed), "sensor_id").join(blocks, "sensor_id")


def early_stopping_tail(frame: DataFrame, seed="tail") -> DataFrame:
    """Add ``is_tail``: the newest ~10 % of rows by date (100 to 50,000, at most half; none below 200 rows).

    Day counts place the boundary; rows are ranked only inside their own day, in
    seeded order, so ties on the boundary day are settled reproducibly.
    """
    n = frame.agg(F.count(F.lit(1))).scalar()
    size = F.least(F.greatest(F.rint(F.lit(0.1) * n), F.lit(100.0)), F.lit(50000.0), F.floor(n / 2).cast("double"))
    newer = W.orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, -1)  # one row per calendar day
    days = (frame.groupBy("date").agg(F.count(F.lit(1)).alias("_c"))
            .select("date", F.coalesce(F.sum("_c").over(newer), F.lit(0)).alias("_newer"), "_c"))
    boundary = (F.col("_newer") < size) & (F.col("_newer") + F.col("_c") > size)
    joined = frame.join(F.broadcast(days), "date")  # one row per calendar day
    inside = joined.filter(~boundary).withColumn("_rank", F.when(F.col("_newer") < size, F.lit(0)).otherwise(n + 1))
    edge = whole_rank(joined.filter(boundary).withColumn("_key", shuffle_key(seed, "sensor_id", "date")), "_key", "_rn")
    edge = edge.withColumn("_rank", F.col("_newer") + F.col("_rn")).drop("_key", "_rn")
    return (inside.unionByName(edge).withColumn("is_tail", (n >= 200) & (F.col("_rank") <= size))
            .drop("_rank", "_newer", "_c"))
