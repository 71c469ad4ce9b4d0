"""Registered queries: the entry point, and a sample next to its reference SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, difference

SAMPLE = ["neighbor_predictor_by_day", "neighbor_features", "neighbor_features_per_fold", "nearest_cell_join", "regulatory_daily",
          "species_merge_proxy", "month_gap_report", "idw_baseline", "morans_by_day", "held_out_blend", "cross_fit_stack",
          "conformal_delta", "strata_metrics", "bootstrap_ci"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, folder, name):
    want = connect(folder).execute(entry.oracle_sql()[name]).df()
    assert difference(entry.queries()[name](spark, folder).toPandas(), want) is None
