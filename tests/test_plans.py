"""Physical-plan checks: no pairwise joins anywhere, pushdown and partial top-k where expected."""

import pytest

import __spark_entry__ as E
from tabsense.operators import filters, profile
from tabsense.plans.catalog import table
from tabsense.plans.queries import FILTER_STATE
from tests.conftest import SF_SMALL

# Queries that fit models or write files execute jobs while building the frame; their final
# plans are checked too, they just take longer to construct.
PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_pairwise_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert not any(op in plan for op in PAIRWISE), plan


def test_filter_pushdown_and_pruning(spark):
    li = table(spark, SF_SMALL, "lineitem")
    plan = _plan(filters.filter_conjunction(li, FILTER_STATE).select("l_orderkey", "l_quantity"))
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan
    scanned = plan[plan.index("FileScan parquet ["):].split("]")[0]
    assert "l_returnflag" in scanned and "l_quantity" in scanned
    assert "l_tax" not in scanned and "l_partkey" not in scanned


def test_top_k_per_column_is_partial(spark):
    plan = _plan(profile.categorical_profile(table(spark, SF_SMALL, "orders")))
    assert "WindowGroupLimit" in plan and "Partial" in plan
