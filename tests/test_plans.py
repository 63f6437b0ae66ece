"""Plan-shape guards: no all-pairs joins, pruned scans, pushed filters."""

import pytest

import __spark_entry__ as entry
from shipwatch.operators import filters
from shipwatch.plans import catalog
from tests.conftest import SF_SMALL

# queries whose construction runs jobs (model fit, stream drain) are left out
SKIP = {"late_risk_predictions", "late_risk_prediction_head", "feature_importance", "scenario_scores", "training_run",
        "stream_alerts", "stream_status_counts"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.QUERIES) - SKIP))
def test_no_all_pairs_joins(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_flagship_scan_is_pruned(spark):
    plan = _plan(entry.entry(spark))
    scan = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    read = scan[scan.index("ReadSchema"):]
    for col in ("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate"):
        assert col in read
    for col in ("l_tax", "l_returnflag", "l_linestatus", "l_comment"):
        assert col not in read


def test_membership_filter_reaches_the_scan(spark):
    lines = catalog.lines(spark, SF_SMALL)
    plan = _plan(filters.apply_filters(lines, markets=["ASIA"], shipping_modes=["Same Day"]))
    region = next(line for line in plan.splitlines() if "region.parquet" in line)
    assert "PushedFilters" in region and "ASIA" in region


def test_scenarios_are_scored_without_all_pairs_joins(spark):
    """Features that a scenario table lacks are constants: they must not become joins without a key."""
    plan = _plan(entry.queries()["scenario_scores"](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
