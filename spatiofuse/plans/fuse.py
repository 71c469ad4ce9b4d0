"""Fusion: residual kriging, cross-fitted stack, recentred and calibrated intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatiofuse.operators import blend, conformal, kriging
from spatiofuse.operators.folds import calibration_flag
from spatiofuse.session import cut_lineage


@dataclass
class Fusion:
    table: DataFrame  # keyed rows with parts, crossfit, meta, centre, lo/hi and calibrated band
    stack: blend.Stack
    delta: float
    n_calibration: int


def fuse(oof: DataFrame, parts: list[str], y: str = "target", alpha: float = 0.1, seed=42) -> Fusion:
    """Stack the out-of-fold ``parts`` and calibrate the band around the stack.

    Sensors are split into meta-training and calibration sets. Meta-training rows
    get the cross-fitted prediction, calibration rows the final combiner's; the
    quantile band (q05, q50, q95) is moved onto that centre and widened by the
    conformal delta of the calibration rows.
    """
    rows = cut_lineage(calibration_flag(oof, seed=seed))
    meta = rows.filter(~F.col("is_cal"))
    crossed, _ = blend.cross_fit_stack(meta, parts, y, seed=seed)
    final = blend.fit_stack(meta, parts, y)
    table = (rows.join(crossed.select("sensor_id", "date", "crossfit"), ["sensor_id", "date"], "left")
             .withColumn("meta", blend.stack_prediction(final))
             .withColumn("centre", F.when(F.col("is_cal"), F.col("meta")).otherwise(F.col("crossfit"))))
    table = cut_lineage(conformal.recentred(table, "centre"))
    found = conformal.conformal_delta(table.filter("is_cal"), y, alpha=alpha).first()
    if found is None:
        raise ValueError("no finite calibration rows")
    table = table.withColumns({"band_lo": F.col("lo") - found["delta"], "band_hi": F.col("hi") + found["delta"]})
    return Fusion(table, final, found["delta"], found["n"])


def with_residual_kriging(oof: DataFrame, pred: str, y: str = "target") -> DataFrame:
    """Add the kriged out-of-fold residual as its own part ``rk``."""
    return oof.join(kriging.residual_kriging(oof, pred, y), ["sensor_id", "date"], "left")
