"""Split-conformal interval calibration on top of recentred quantile bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiofuse.functions.quantiles import value_positions


def rearranged(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sort each row's quantiles so that they never cross; rows with a NULL are left as they are."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    ordered = F.array_sort(F.array(*columns))
    return df.withColumns({c: F.when(whole, ordered[i]).otherwise(F.col(c)) for i, c in enumerate(columns)})


def recentred(df: DataFrame, centre: str, q_lo: str = "q05", q_mid: str = "q50", q_hi: str = "q95") -> DataFrame:
    return df.withColumns({"lo": F.col(centre) - (F.col(q_mid) - F.col(q_lo)),
                           "hi": F.col(centre) + (F.col(q_hi) - F.col(q_mid))})


def score(y: str, lo: str, hi: str) -> Column:
    both = F.col(y).isNotNull() & F.col(lo).isNotNull() & F.col(hi).isNotNull()
    return F.when(both, F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi)))


def _position(alpha: float):
    """0-based index of the ceil((n+1)(1−α))/n quantile taken with the 'higher' rule."""
    def at(n: Column) -> Column:
        m = F.ceil((n + 1) * F.lit(1.0 - alpha))
        return F.when(m < n, m).otherwise(n - 1)
    return at


def conformal_delta(calibration: DataFrame, y: str = "target", lo: str = "lo", hi: str = "hi", alpha: float = 0.1) -> DataFrame:
    """One row (n, delta): how far the calibration scores say the band must widen."""
    scores = calibration.select(score(y, lo, hi).alias("score"))
    return value_positions(scores, "score", {"delta": _position(alpha)})


def coverage_curve(calibration: DataFrame, evaluation: DataFrame, alphas: list[float],
                   y: str = "target", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Empirical coverage at each nominal level, the band recalibrated per level."""
    names = {f"a{i}": a for i, a in enumerate(alphas)}

    def at(a: float):
        return lambda n: F.ceil(F.least(F.lit(1.0), F.lit(1.0 - a) * (1.0 + 1.0 / n)) * (n - 1))

    deltas = value_positions(calibration.select(score(y, lo, hi).alias("score")), "score",
                             {k: at(a) for k, a in names.items()})
    row = deltas.first()  # one number per level
    if row is None:
        raise ValueError("no finite calibration rows")
    levels = F.array(*[F.struct(F.lit(1.0 - a).alias("nominal"), F.lit(float(row[k])).alias("delta"))
                       for k, a in names.items()])
    scored = evaluation.select(score(y, lo, hi).alias("s")).filter("s IS NOT NULL").select("s", F.explode(levels).alias("l"))
    return (scored.groupBy(F.col("l.nominal").alias("nominal"), F.col("l.delta").alias("delta"))
            .agg(F.avg((F.col("s") <= F.col("l.delta")).cast("double")).alias("empirical")))


def default_alphas(alpha0: float = 0.1) -> list[float]:
    grid = [0.02 + (0.5 - 0.02) * i / 24 for i in range(25)]
    return sorted({round(a, 4) for a in [*grid, alpha0]})
