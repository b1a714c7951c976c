"""Plan shape: the properties that matter at scale, read from the physical plans."""
import pytest

from conftest import sf_dir
from fieldlens.operators import monitor as M
from fieldlens.plans import registry as R

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_no_cross_products(spark, name):
    plan = _plan(R.QUERIES[name](spark, sf_dir("0.001")))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"


def test_flag_filter_and_pruning_reach_the_scan(spark):
    f = R.flagged(spark, sf_dir("0.001"))
    plan = _plan(f.where("Flag_FCS_Overall = 1").select("_uuid"))
    assert "PushedFilters: [IsNotNull(Flag_FCS_Overall), EqualTo(Flag_FCS_Overall,1)]" in plan
    assert "ReadSchema: struct<_uuid:bigint,Flag_FCS_Overall:int>" in plan


def test_top_k_is_partial_before_shuffle(spark):
    f = R.flagged(spark, sf_dir("0.001"))
    f.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(M.expenditure_extremes(f))
    finally:
        f.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_group_rates_pre_aggregate_pairs(spark):
    f = R.flagged(spark, sf_dir("0.001"))
    f.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(M.flag_rate_by_enumerator(f, R._report(f)))
    finally:
        f.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    # partial aggregation of (id, enumerator) pairs happens before the first exchange
    first_exchange = plan.index("Exchange")
    assert "HashAggregate(keys=[_uuid" in plan[first_exchange:]
