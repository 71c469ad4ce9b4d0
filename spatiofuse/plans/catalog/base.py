"""Registration of queries with their reference SQL, and frames several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatiofuse.functions.scalar import round_all, with_target
from spatiofuse.operators.folds import with_sensor_folds
from spatiofuse.plans.features import Sources
from spatiofuse.session import cut_lineage
from spatiofuse.sources import ingest
from spatiofuse.sources.derived import Inputs

# Registered queries by name, and the SQL that must give the same rows.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def presented(df: DataFrame) -> DataFrame:
    """Six decimal places and ISO dates, so results compare across engines.

    The tiny shift (also in the SQL) keeps decimal halves from rounding apart.
    """
    df = round_all(df, 6, 1.3e-9)
    dates = [f.name for f in df.schema.fields if f.dataType.simpleString() == "date"]
    return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: presented(fn(Inputs(spark, folder)))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def panel(i: Inputs) -> DataFrame:
    """Cleaned sensor-day panel with the corrected target."""
    return with_target(ingest.sensor_day_panel(i.sensor_days))


def folded(i: Inputs, n: int = 10) -> DataFrame:
    return with_sensor_folds(panel(i), n)


def reference_daily(i: Inputs) -> DataFrame:
    return ingest.regulatory_daily(ingest.regulatory_rows(i.reference_feed))


def sources(i: Inputs) -> Sources:
    """Feature sources; the daily products are written once, as a real run would."""
    sensor_elevation, tract_elevation = ingest.elevation_maps(i.elevation_documents)
    return Sources(
        tracts=i.tracts, smoke=i.smoke, aerosol=cut_lineage(i.daily_cells), sensor_elevation=sensor_elevation,
        tract_elevation=tract_elevation, forecast=cut_lineage(ingest.forecast_daily(i.hourly_forecast)),
        reanalysis=cut_lineage(ingest.reanalysis_daily(i.hourly_species, i.hourly_boundary_layer)), membership=i.membership)
