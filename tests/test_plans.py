"""Plan-shape checks: no nested-loop or Cartesian joins, partial top-k, pruned scans."""

import pytest

from parlance.plans import registry

from conftest import SF_SMALL

QUERIES = registry.queries()
BATCH = sorted(k for k in QUERIES if not (k.startswith("stream") or k == "message_stream"))


def plan_of(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", BATCH)
def test_no_nested_loop_or_cartesian_join(spark, key):
    plan = plan_of(spark, key)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("key", ["catalog_listing", "last_n_messages", "dense_top_k", "sparse_top_k"])
def test_top_k_is_partial_before_shuffle(spark, key):
    assert "WindowGroupLimit" in plan_of(spark, key)


def test_scans_are_pruned(spark):
    plan = plan_of(spark, "customer_history")
    # orders is read without its status / priority columns
    assert "o_orderpriority" not in plan and "o_orderstatus" not in plan
