"""Physical plans of the core queries: what must not appear at scale."""

from pathlib import Path

import pytest

from airloom.catalog import CATALOG, base

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")

HEAVY = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "aqi_by_location", "parameter_stats", "daily_means", "pair_correlations", "period_aqi", "histogram", "box_plots_daily",
    "violin_density", "first_readings", "new_readings", "validated_records", "rolling_day_mean", "random_sample", "ks_drift",
])
def test_no_cross_joins_and_no_python(spark, name):
    plan = plan_of(CATALOG[name].run(spark, SF_DIR))
    assert [word for word in HEAVY if word in plan] == []


@pytest.mark.parametrize("name", ["aqi_by_location", "daily_means", "hourly_aqi", "pair_correlations", "merge_summary", "location_profile"])
def test_large_sides_use_hash_aggregates(spark, name):
    assert "SortAggregate" not in plan_of(CATALOG[name].run(spark, SF_DIR))


def test_only_needed_columns_are_read(spark):
    plan = plan_of(CATALOG["records_per_location"].run(spark, SF_DIR))
    assert "ReadSchema: struct<user_id:bigint>" in plan


def test_pivot_takes_one_exchange(spark):
    plan = plan_of(base.aqi(spark, SF_DIR))
    assert plan.count("Exchange") == 1


def test_latest_records_are_limited_before_the_shuffle(spark):
    plan = plan_of(CATALOG["latest_per_location"].run(spark, SF_DIR))
    assert plan.count("WindowGroupLimit") == 2
