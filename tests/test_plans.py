"""What the optimiser makes of the queries: pushed filters, pruned columns, limits before shuffles, no pair products."""

import os

import pytest

from talentweave.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Queries whose cross join is with a stated, bounded side: query vectors, one row, or a word list.
STATED = {"fallback_nearest", "fallback_not_needed", "filtered_search_pipeline", "lateral_topk_per_scope", "mmr_select", "rerank_cosine", "schedule_reference", "semantic_search_pipeline", "source_rollup", "top_source"}


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_scope_and_columns_reach_the_scan(spark):
    text = plan(spark, "scope_wrapper")
    assert "PushedFilters: [GreaterThanOrEqual(c_acctbal" in text or "c_acctbal" in text.split("PushedFilters:")[1][:200]
    read = plan(spark, "pricing_summary").split("FileScan parquet [")[1].split("]")[0]
    assert {c.split("#")[0] for c in read.split(",")} == {"l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"}


def test_limits_come_before_the_shuffle(spark):
    assert "TakeOrderedAndProject" in plan(spark, "candidate_top_nulls_first")
    assert "WindowGroupLimit" in plan(spark, "knn_topk") and "WindowGroupLimit" in plan(spark, "top_per_group")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_query_pairs_unbounded_sides(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert name in STATED or "BroadcastNestedLoopJoin" not in text
