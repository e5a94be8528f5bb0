"""Derive the wide customer record from the driver's TPC-H-like tables.

The driver tables carry no churn columns, so the 17-column customer record is
derived from ``customer, nation, region, orders, lineitem``:

* a customer exists if it has at least one order;
* ``join_date`` is the date of its lowest order key, ``last_d`` its latest order
  date, ``as_of`` the latest order date overall;
* it is churned when ``as_of - last_d > 270`` days; then it cancelled on
  ``last_d`` for the priority of its latest order (ties: highest order key);
* usage comes from lineitem (``'N'`` lines = logins, mean quantity = minutes)
  and from orders (pending urgent = billing issues, pending high = tickets).

Plan shape (three shuffles, none of them on a hot key):
lineitem is pre-aggregated per order *before* the join (partial + final
aggregate on ``l_orderkey``; lines of one order sit together in the files, so
the map-side combine removes most rows; quantities are summed as hundredths in two
bigints, which is exact and spares a wide decimal for each line), joined to orders on the unique order
key, then aggregated per customer with map-side partial aggregation (a customer
with a third of all orders becomes one partial row per task, not a hot
partition).  ``as_of`` is a scalar subquery (one value, computed once).  The
nation/region dimension and the customer join are left to Catalyst's size-based
choice and AQE, which use a sort-merge join when a side is large.
"""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.dates import months_between_div30
from churnlens.functions.tiers import age_group
from churnlens.schemas import METRIC_TYPE, PAYMENT_METHODS, PLANS, PRICE_TYPE, WIDE_COLUMNS

# ---------------------------------------------------------------------------
# Fixed values of the derivation.
# ---------------------------------------------------------------------------
SOURCE_TABLES = ("customer", "nation", "region", "orders", "lineitem")
CHURN_GAP_DAYS = 270
SEGMENT_TO_PLAN = {
    "AUTOMOBILE": "Basic",
    "BUILDING": "Basic",
    "FURNITURE": "Standard",
    "HOUSEHOLD": "Standard",
    "MACHINERY": "Premium",
}
AGE_BASE = 18
AGE_SPAN = 63
LOGIN_FLAG = "N"
PENDING_STATUS = "P"
BILLING_PRIORITY = "1-URGENT"
TICKET_PRIORITY = "2-HIGH"
# hundredths of a quantity (below 10**18, so below 2**60) are summed in halves of LOW_BITS
LOW_BITS = 30
# ---------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _plan_name(segment: F.Column) -> F.Column:
    expr = None
    for seg, plan in SEGMENT_TO_PLAN.items():
        expr = F.when(segment == seg, plan) if expr is None else expr.when(segment == seg, plan)
    return expr


def _plan_price(plan: F.Column) -> F.Column:
    expr = None
    for name, price, _ in PLANS:
        lit = F.lit(price).cast(PRICE_TYPE)
        expr = F.when(plan == name, lit) if expr is None else expr.when(plan == name, lit)
    return expr


def _payment_method(key: F.Column) -> F.Column:
    idx = F.pmod(key, F.lit(len(PAYMENT_METHODS)))
    expr = None
    for i, name in enumerate(PAYMENT_METHODS):
        expr = F.when(idx == i, name) if expr is None else expr.when(idx == i, name)
    return expr


def _whole(high: F.Column, low: F.Column) -> F.Column:
    """The quantity whose hundredths were summed in halves."""
    hundredths = high.cast("decimal(19,0)") * F.lit(1 << LOW_BITS).cast("decimal(10,0)") + low.cast("decimal(19,0)")
    return (hundredths * F.lit(Decimal("0.01"))).cast("decimal(38,2)")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with order-derived facts and lineitem usage sums."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
    )
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    hundredths = (F.col("l_quantity").cast("decimal(18,2)") * 100).cast("bigint")
    per_order_lines = lines.withColumn("hundredths", hundredths).groupBy("l_orderkey").agg(
        F.count(F.when(F.col("l_returnflag") == LOGIN_FLAG, True)).alias("flag_lines"),
        F.sum(F.shiftright("hundredths", LOW_BITS)).alias("qty_high"),
        F.sum(F.col("hundredths").bitwiseAND((1 << LOW_BITS) - 1)).alias("qty_low"),
        F.count("l_quantity").alias("qty_n"),
    )
    per_order = orders.join(
        per_order_lines, orders["o_orderkey"] == per_order_lines["l_orderkey"], "left"
    )
    pending = F.col("o_orderstatus") == PENDING_STATUS
    return per_order.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.min_by("o_orderdate", "o_orderkey").alias("join_date"),
        F.max("o_orderdate").alias("last_order_date"),
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("last_priority"),
        F.count(F.when(pending & (F.col("o_orderpriority") == BILLING_PRIORITY), True))
        .alias("billing_issues_count"),
        F.count(F.when(pending & (F.col("o_orderpriority") == TICKET_PRIORITY), True))
        .alias("support_tickets"),
        F.sum("flag_lines").alias("flag_lines"),
        _whole(F.sum("qty_high"), F.sum("qty_low")).alias("qty_sum"),
        F.sum("qty_n").alias("qty_n"),
    )


def derive_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean 17-column customer record (schema ``WIDE_SCHEMA``)."""
    facts = order_facts(spark, sf_dir)
    # the data's as-of date: a scalar subquery, computed once and used like a literal
    as_of = read_table(spark, sf_dir, "orders").agg(F.max(F.col("o_orderdate").cast("date"))).scalar()
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # Catalyst broadcasts this dimension by its size
    geo = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left")

    joined = (
        facts.join(customer, facts["customer_id"] == customer["c_custkey"], "inner")
        .join(geo, F.col("c_nationkey") == geo["n_nationkey"], "left")
    )
    churned = F.datediff(as_of, F.col("last_order_date")) > CHURN_GAP_DAYS
    plan = _plan_name(F.col("c_mktsegment"))
    age = (F.lit(AGE_BASE) + F.pmod(F.col("customer_id"), F.lit(AGE_SPAN))).cast("int")
    minutes = F.coalesce(
        # narrow operands keep 16 fractional digits in the quotient: exact rounding
        # even for a customer holding a third of all lines
        F.round(F.try_divide(F.col("qty_sum").cast("decimal(24,2)"), F.col("qty_n").cast("decimal(20,0)")), 1),
        F.lit(0),
    ).cast(METRIC_TYPE)
    wide = joined.select(
        F.col("customer_id").cast("bigint").alias("customer_id"),
        age.alias("age"),
        age_group(age).alias("age_group"),
        F.col("r_name").alias("region"),
        plan.alias("plan_name"),
        _plan_price(plan).alias("plan_price"),
        _payment_method(F.col("customer_id")).alias("payment_method"),
        F.col("join_date"),
        months_between_div30(as_of, "join_date").alias("tenure_months"),
        F.coalesce(F.col("flag_lines"), F.lit(0)).cast(METRIC_TYPE).alias("avg_monthly_logins"),
        minutes.alias("avg_session_minutes"),
        F.col("support_tickets").cast("bigint").alias("support_tickets"),
        F.col("billing_issues_count").cast("bigint").alias("billing_issues_count"),
        churned.alias("is_churned"),
        F.when(churned, F.col("last_order_date")).alias("cancellation_date"),
        F.when(churned, F.col("last_priority")).alias("cancellation_reason"),
        F.when(churned, F.datediff(F.col("last_order_date"), F.col("join_date")))
        .otherwise(F.datediff(as_of, F.col("join_date")))
        .cast("int").alias("customer_lifetime_days"),
    )
    return wide.select(*WIDE_COLUMNS)
