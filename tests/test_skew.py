"""Hot keys: one customer holds a third of all orders (and of the dirty records).

A skewed copy of the sf0.01 tables is written to a scratch folder; the derived
tables and a set of queries must still agree with the DuckDB oracle on it, and
the per-customer aggregation must stay a partial (map-side) aggregate.
"""

from __future__ import annotations

import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from churnlens.operators import cleaning
from churnlens.plans.catalog import TableCache, registry
from churnlens.plans.oracle_check import compare, duck
from churnlens.sources.tpch import order_facts
from tests.conftest import SF_ORACLE

HOT = 7
CHECKED = [
    "overall_churn", "lifetime_by_status", "churn_by_region_ranked", "churn_by_login_tier",
    "high_risk_customers", "cancellation_reasons", "churn_correlations", "engagement_bins",
    "clean_records", "clean_records_key_dedup", "cleaning_report", "check_primary_key",
]


@pytest.fixture(scope="module")
def skewed_dir(spark):
    out = tempfile.mkdtemp(prefix="churnlens-skew-")
    for name in ["region", "nation", "customer", "lineitem", "events"]:
        os.symlink(os.path.join(SF_ORACLE, f"{name}.parquet"), os.path.join(out, f"{name}.parquet"))
    orders = spark.read.parquet(os.path.join(SF_ORACLE, "orders.parquet"))
    hot = orders.withColumn(
        "o_custkey", F.when(F.pmod(F.col("o_orderkey"), F.lit(3)) == 0, F.lit(HOT).cast("bigint"))
        .otherwise(F.col("o_custkey")))
    hot.coalesce(1).write.parquet(os.path.join(out, "orders.parquet"))
    return out


def test_hot_customer_holds_a_third(spark, skewed_dir):
    orders = spark.read.parquet(os.path.join(skewed_dir, "orders.parquet"))
    share = orders.filter(F.col("o_custkey") == HOT).count() / orders.count()
    assert share > 0.33


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_oracle_under_skew(spark, skewed_dir, name):
    qs = registry(TableCache())
    ok, why = compare(qs[name](spark, skewed_dir), duck(skewed_dir), entry_mod.oracle_sql()[name])
    assert ok, f"{name}: {why}"


def test_per_customer_aggregate_is_partial(spark, skewed_dir):
    text = order_facts(spark, skewed_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in text and "partial_max_by" in text and "partial_sum" in text


def test_quantities_beyond_a_bigint_sum_exactly(spark, tmp_path):
    """More hundredths than a bigint holds, negative and absent quantities; no wide decimal is summed line by line."""
    orders = [(1, 7, "P", "2-HIGH"), (2, 7, "F", "5-LOW"), (3, 8, "O", "5-LOW"), (4, 9, "O", "5-LOW")]
    lines = [(1, 9.0e15)] * 25 + [(1, -0.01), (2, None), (2, 12.34), (3, -5.5), (3, -0.07), (4, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string") \
        .withColumn("o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double").withColumn("l_returnflag", F.lit("N")) \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    facts = order_facts(spark, str(tmp_path))
    found = {r.customer_id: (r.qty_sum, r.qty_n) for r in facts.collect()}
    assert found == {7: (Decimal("225000000000000012.33"), 27), 8: (Decimal("-5.57"), 2), 9: (None, 0)}
    assert "partial_sum(cast(l_quantity" not in facts._jdf.queryExecution().executedPlan().toString()


def test_hot_duplicate_group_collapses_map_side(small_tables):
    """A third of the rows are identical copies of one record: dedup stays partial + final."""
    wide = small_tables.wide
    copies = wide.filter("customer_id = 3").withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(75)))).drop("_k")
    one = cleaning.exact_dedup(wide.unionByName(copies))
    text = one._jdf.queryExecution().executedPlan().toString()
    assert text.count("HashAggregate") >= 2  # partial + final
    assert one.count() == wide.count()
