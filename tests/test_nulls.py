"""NULL semantics: every query against its oracle on a copy of the tables with NULLs injected.

NULL nation (so NULL region), NULL market segment (so NULL plan and price),
NULL order priority (NULL cancellation reasons), NULL line quantity and
return flag.  Spark and the SQL oracle must agree on grouping, ordering,
joins and aggregates over these NULLs.
"""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from churnlens.plans.catalog import TableCache, registry
from churnlens.plans.oracle import ORACLE_SQL
from churnlens.plans.oracle_check import compare, duck
from tests.conftest import SF_ORACLE


@pytest.fixture(scope="module")
def null_dir(spark):
    out = tempfile.mkdtemp(prefix="churnlens-nulls-")
    for name in ["region", "nation", "events"]:
        os.symlink(os.path.join(SF_ORACLE, f"{name}.parquet"), os.path.join(out, f"{name}.parquet"))
    read = lambda n: spark.read.parquet(os.path.join(SF_ORACLE, f"{n}.parquet"))
    customer = read("customer").select(
        "c_custkey", "c_name",
        F.when(F.pmod("c_custkey", F.lit(17)) == 3, F.lit(None)).otherwise(F.col("c_nationkey"))
        .cast("int").alias("c_nationkey"),
        "c_acctbal",
        F.when(F.pmod("c_custkey", F.lit(19)) == 4, F.lit(None)).otherwise(F.col("c_mktsegment"))
        .cast("string").alias("c_mktsegment"),
    )
    orders = read("orders").withColumn(
        "o_orderpriority",
        F.when(F.pmod("o_orderkey", F.lit(23)) == 5, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")))
    lineitem = read("lineitem").withColumn(
        "l_quantity", F.when(F.pmod("l_orderkey", F.lit(29)) == 7, F.lit(None).cast("double"))
        .otherwise(F.col("l_quantity"))
    ).withColumn(
        "l_returnflag", F.when(F.pmod("l_orderkey", F.lit(31)) == 8, F.lit(None).cast("string"))
        .otherwise(F.col("l_returnflag")))
    for name, df in [("customer", customer), ("orders", orders), ("lineitem", lineitem)]:
        df.coalesce(1).write.parquet(os.path.join(out, f"{name}.parquet"))
    return out


@pytest.fixture(scope="module")
def con(null_dir):
    return duck(null_dir)


@pytest.fixture(scope="module")
def qs():
    return registry(TableCache())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle_with_nulls(spark, null_dir, con, qs, name):
    ok, why = compare(qs[name](spark, null_dir), con, ORACLE_SQL[name])
    assert ok, f"{name}: {why}"


def test_nulls_reach_the_derived_record(spark, null_dir, qs):
    from churnlens.plans.tables import ChurnTables
    w = ChurnTables.derive(spark, null_dir).wide
    row = w.agg(
        F.sum(F.col("region").isNull().cast("int")).alias("region"),
        F.sum(F.col("plan_name").isNull().cast("int")).alias("plan"),
        F.sum((F.col("is_churned") & F.col("cancellation_reason").isNull()).cast("int")).alias("reason"),
    ).first()
    assert row.region > 0 and row.plan > 0 and row.reason > 0
