"""Queries that need boxes and truth read and group the items once, and fit once."""

import pytest

from tracklens.plans import QUERIES
from tracklens.plans.features import rated


@pytest.mark.parametrize("name", "coverage_metrics gate_1f_rows best_quantile_labels quantile_relatives best_policy allowed_features zscore_features looming_with_fallback event_feature_join run_summary_rollup failure_classes".split())
def test_items_are_grouped_before(spark, sf, name):
    """F8, F9, F11, F12, F14, F18, F20, F21, F22: before, each of boxes, their sizes and the truth's points read all items."""
    files = QUERIES[name](spark, sf).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]


def test_rated_reads_one_table(spark, sf):
    assert {f.split("/")[-2].split("-")[0] for f in rated(spark, sf).inputFiles()} == {"monthly"}


@pytest.mark.parametrize("name", ["box_aux_features", "looming_records"])
def test_records_are_planned_in_parts(spark, sf, name):
    """before, one plan read events and items in all branches, and the driver planned it anew after each of its stages."""
    df = QUERIES[name](spark, sf)
    files = df.inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "events" in f]
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 20
