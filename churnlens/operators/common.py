"""Shared building blocks of the analytics operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.numeric import flag, rate_pct
from churnlens.plans.tables import ChurnTables


def churn_aggs(
    count_col: str | None = None,
    total_name: str = "total_customers",
    churned_name: str = "churned",
    rate_name: str = "churn_rate_pct",
    flag_col: str = "is_churned",
) -> list[Column]:
    """COUNT, SUM(flag::int) and ROUND(rate * 100, 2) as one list of aggregate columns."""
    total = F.count(F.col(count_col)) if count_col else F.count(F.lit(1))
    churned = F.sum(flag(flag_col))
    return [
        total.alias(total_name),
        churned.cast("bigint").alias(churned_name),
        rate_pct(churned, total).alias(rate_name),
    ]


def churn_by(df: DataFrame, *keys: str | Column, count_col: str | None = None, **names: str) -> DataFrame:
    """The shared segment aggregate: total, churned and churn rate % per key combination.

    One grouped aggregate with map-side partial aggregation; ``names`` renames
    the output columns (``total_name``, ``churned_name``, ``rate_name``).
    """
    return df.groupBy(*keys).agg(*churn_aggs(count_col=count_col, **names))


def customer_plan(tables: ChurnTables, active: bool | None = None) -> DataFrame:
    """customers JOIN subscriptions JOIN subscription_plans.

    customers and subscriptions share the ``customer_id`` bucketing when
    materialised, so their join needs no exchange; the plan lookup is broadcast
    by its size in the statistics where that is small.
    """
    subs = tables.subscriptions.select("customer_id", "plan_id", "is_active")
    if active is not None:
        subs = subs.filter(F.col("is_active") == F.lit(active))
    plans = tables.subscription_plans.select("plan_id", "plan_name", "price")
    return tables.customers.join(subs, "customer_id", "inner").join(plans, "plan_id", "inner")


def customer_usage(tables: ChurnTables) -> DataFrame:
    """customers JOIN usage_metrics on the shared ``customer_id`` bucketing."""
    return tables.customers.join(tables.usage_metrics, "customer_id", "inner")
