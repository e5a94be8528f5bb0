"""Core churn metrics: overall KPIs, lifetime by status, recurring and lost revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.numeric import flag, rate_pct, round_ratio
from churnlens.operators.common import customer_plan
from churnlens.plans.tables import ChurnTables


def overall_churn(tables: ChurnTables) -> DataFrame:
    """Total, churned and active customers with churn and retention rates (%)."""
    c = tables.customers
    total = F.count(F.lit(1))
    churned = F.sum(flag("is_churned"))
    return c.agg(
        total.alias("total_customers"),
        churned.cast("bigint").alias("total_churned"),
        (total - churned).cast("bigint").alias("total_active"),
        rate_pct(churned, total).alias("churn_rate_pct"),
        rate_pct(total - churned, total).alias("retention_rate_pct"),
    )


def lifetime_by_status(tables: ChurnTables) -> DataFrame:
    """Customer count and lifetime statistics per status ('Active' first)."""
    c = tables.customers
    days = F.col("customer_lifetime_days")
    n_days = F.count(days)
    agg = c.groupBy("is_churned").agg(
        F.count(F.lit(1)).alias("customer_count"),
        round_ratio(F.sum(days), n_days, 0).alias("avg_lifetime_days"),
        round_ratio(F.sum(days), n_days * F.lit(30), 1).alias("avg_lifetime_months"),
        F.min(days).cast("bigint").alias("min_lifetime_days"),
        F.max(days).cast("bigint").alias("max_lifetime_days"),
    )
    return agg.orderBy(F.col("is_churned").asc_nulls_last()).select(
        F.when(F.col("is_churned"), "Churned").otherwise("Active").alias("customer_status"),
        "customer_count", "avg_lifetime_days", "avg_lifetime_months",
        "min_lifetime_days", "max_lifetime_days",
    )


def revenue(count_col: F.Column, price_col: F.Column, months: int = 1) -> F.Column:
    value = count_col.cast("decimal(20,0)") * price_col
    if months != 1:
        value = value * F.lit(months).cast("decimal(4,0)")
    return F.round(value, 2).cast("double")


def mrr_by_plan(tables: ChurnTables) -> DataFrame:
    """Monthly recurring revenue of active subscriptions per plan.

    ``churn_rate_pct`` is measured among the active rows, so it is 0 whenever
    ``is_active = NOT is_churned`` as in the load step.
    """
    joined = customer_plan(tables, active=True)
    n = F.count("customer_id")
    agg = joined.groupBy("plan_name", "price").agg(
        n.alias("active_subscribers"),
        revenue(n, F.col("price")).alias("monthly_revenue"),
        rate_pct(F.sum(flag("is_churned")), F.count(F.lit(1))).alias("churn_rate_pct"),
    )
    return agg.orderBy(F.col("price").desc()).select(
        "plan_name",
        F.col("price").cast("double").alias("monthly_price"),
        "active_subscribers", "monthly_revenue", "churn_rate_pct",
    )


def revenue_lost_by_plan(tables: ChurnTables) -> DataFrame:
    """Monthly and annualised revenue lost to churned customers, per plan."""
    joined = customer_plan(tables, active=False).filter(F.col("is_churned"))
    n = F.count("customer_id")
    agg = joined.groupBy("plan_name", "price").agg(
        n.alias("churned_customers"),
        revenue(n, F.col("price")).alias("monthly_revenue_lost"),
        revenue(n, F.col("price"), months=12).alias("annualized_revenue_lost"),
    )
    return agg.orderBy(F.col("monthly_revenue_lost").desc_nulls_first()).select(
        "plan_name", "churned_customers", "monthly_revenue_lost", "annualized_revenue_lost"
    )

