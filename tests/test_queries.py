"""Every registered query against its SQL twin, and plan rules over all of them."""

import pytest

from __spark_entry__ import entry
from caseledger.plans.catalog import ORACLES, QUERIES
from oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    assert compare(spark, con, name, sf, QUERIES, ORACLES) == ""


RANKED = ["d15_masked_intensity", "d18_roc_auc", "d19_average_precision", "d20_roc_curve", "d21_froc_curve", "d22_operating_points",
          "d29_source_separated_table", "d33_localiser_error_metrics", "d34_stratified_bootstrap", "d8_exact_percentiles",
          "e1_rank_within_case", "e2_running_totals_global", "e9_evidence_order"]


@pytest.mark.parametrize("name", RANKED)
def test_query_equals_sql_when_everything_is_hot(spark, con, sf, name, monkeypatch):
    """The same queries, forced through the bands that large tables take."""
    from caseledger.operators import ordering

    monkeypatch.setattr(ordering, "HOT_ROWS", 4)
    assert compare(spark, con, name, sf, QUERIES, ORACLES) == ""


ROUNDED = ["d28_subgroup_table", "d29_source_separated_table", "d31_manual_only_table", "d32_arm_summary",
           "j9_publication_table", "j10_cohort_performance_wide", "j15_cohort_delta"]


@pytest.mark.parametrize("name", ROUNDED)
def test_means_at_rounding_ties(spark, name):
    """Averages of the same columns on a larger table, where some lie on a tie of the last digit."""
    import os

    larger = "/root/testdata/sf0.01"
    if not os.path.exists(larger):
        pytest.skip("no larger tables here")
    assert compare(spark, duck(larger), name, larger, QUERIES, ORACLES) == ""


def test_entry(spark):
    assert entry(spark).count() == 6


def test_only_file_listings_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"a9_file_inventory", "a10_file_hashes"}
