"""Physical-plan properties: no Python in the hot path, bounded broadcasts,
top-k as TakeOrderedAndProject, bucketed joins without an exchange."""

from __future__ import annotations

import pytest

from churnlens.operators import risk, segments, statistics
from churnlens.plans.catalog import registry
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def full(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(registry()))
def test_no_python_udf_in_any_query(spark, cache, name):
    df = registry(cache)[name](spark, SF_SMALL)
    text = full(df)
    assert not any(node in text for node in PYTHON_NODES), name


def test_top_k_is_take_ordered(small_tables):
    assert "TakeOrderedAndProject" in plan(risk.high_risk_customers(small_tables))


def test_plan_lookup_is_broadcast(small_tables):
    from churnlens.operators import kpis
    assert "BroadcastExchange" in plan(kpis.mrr_by_plan(small_tables))


def test_bucketed_join_has_no_exchange_on_customer_id(spark, small_tables):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(segments.churn_by_login_tier(small_tables))
        assert "SortMergeJoin" in text
        assert "Exchange hashpartitioning(customer_id" not in text
        assert "Bucketed: true" in full(segments.churn_by_login_tier(small_tables))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_correlations_scan_once(small_tables):
    text = plan(statistics.churn_correlations(small_tables))
    assert text.count("FileScan") == 1


def test_filters_and_columns_pushed_to_scan(small_tables):
    text = full(risk.cancellation_reasons(small_tables))
    assert "PushedFilters: [IsNotNull(is_churned), EqualTo(is_churned,true), IsNotNull(cancellation_reason)]" in text
    assert "ReadSchema: struct<is_churned:boolean,cancellation_reason:string>" in text


def test_no_cross_join_in_any_query(spark, cache):
    """No CartesianProduct or nested-loop join, also with the size-based broadcast off."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, fn in registry(cache).items():
            text = plan(fn(spark, SF_SMALL))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _children(node):
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _single_partition_inputs(node, found):
    """Collect the child node of every shuffle into a single partition."""
    if node.getClass().getSimpleName() == "ShuffleExchangeExec" and \
            node.outputPartitioning().getClass().getSimpleName().startswith("SinglePartition"):
        found.append(node.child())
    for child in _children(node):
        _single_partition_inputs(child, found)
    return found


def _strip(node):
    # look through row/column transitions and codegen wrappers to the operator
    while node.getClass().getSimpleName() in ("WholeStageCodegenExec", "InputAdapter", "ProjectExec",
                                              "FilterExec", "ColumnarToRowExec"):
        node = node.child()
    return node.getClass().getSimpleName()


def test_single_partition_shuffles_only_carry_aggregates(spark, cache):
    """Nothing unbounded goes through one task: a single-partition shuffle reads aggregated rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, fn in registry(cache).items():
            plan_node = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan()
            for child in _single_partition_inputs(plan_node, []):
                kind = _strip(child)
                assert kind in ("HashAggregateExec", "SortAggregateExec", "ObjectHashAggregateExec",
                                "GenerateExec", "WindowExec"), f"{name}: single partition over {kind}"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
