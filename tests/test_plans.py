"""Physical plans of the registered queries: no cross products, no whole-table windows in one task."""

import re

import pytest

from siftwell.plans import load_plans

FOLDER = "/root/testdata/sf0.001"
PLANS = {n: p for n, p in load_plans().items() if not n.startswith("stream_") and n != "ancestor_walk"}
# Windows over one row per bucket, per funnel stage or per page of a listing.
SMALL_WINDOWS = {"queue_position", "sheet_export", "conversion_funnel"}


@pytest.mark.parametrize("name", PLANS)
def test_plan_shape(spark, name):
    plan = PLANS[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in SMALL_WINDOWS:
        assert not re.search(r"Window [^\n]*\n[^\n]*(Sort [^\n]*\n)?[^\n]*Exchange SinglePartition", plan)


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = load_plans()["search_unexpired_fresh"].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert "o_totalprice" not in schema
    plan = load_plans()["quality_flags"].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan and "GreaterThanOrEqual(value,1.0)" in plan
    assert "props" not in re.search(r"ReadSchema: (\S+)", plan).group(1)
