"""Risk operators: top-100 risky active customers, cancellation-reason shares and
the rule-based churn probability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.numeric import round_ratio
from churnlens.functions.tiers import churn_probability as churn_probability_expr
from churnlens.functions.tiers import risk_score
from churnlens.plans.tables import ChurnTables

HIGH_RISK_LIMIT = 100


def high_risk_customers(tables: ChurnTables, limit: int = HIGH_RISK_LIMIT) -> DataFrame:
    """Active customers ordered by risk score (desc) then logins (asc), top ``limit``.

    ``customer_id`` is the final sort key so the cut at ``limit`` is
    deterministic.  The sort + limit plans as ``TakeOrderedAndProject``: each
    task keeps its own top ``limit`` rows and only those reach the final merge.
    """
    subs = tables.subscriptions.filter(F.col("is_active")).select("customer_id", "plan_id")
    plans = tables.subscription_plans.select("plan_id", "plan_name", "price")
    usage = tables.usage_metrics.select("customer_id", "avg_monthly_logins", "billing_issues_count")
    joined = (
        tables.customers.filter(~F.col("is_churned"))
        .join(subs, "customer_id", "inner")
        .join(plans, "plan_id", "inner")
        .join(usage, "customer_id", "inner")
    )
    scored = joined.select(
        "customer_id", "age_group", "region", "plan_name",
        F.col("price").cast("double").alias("monthly_price"),
        F.col("tenure_months").cast("bigint").alias("tenure_months"),
        F.col("avg_monthly_logins").cast("double").alias("avg_monthly_logins"),
        F.col("billing_issues_count").cast("bigint").alias("billing_issues_count"),
        risk_score("tenure_months", "avg_monthly_logins", "billing_issues_count").alias("risk_score"),
    )
    return scored.orderBy(
        F.col("risk_score").desc(), F.col("avg_monthly_logins").asc_nulls_last(), F.col("customer_id").asc()
    ).limit(limit)


def cancellation_reasons(tables: ChurnTables) -> DataFrame:
    """Reason counts among churned customers with their share of all stated reasons (%)."""
    counts = (
        tables.customers.filter(F.col("is_churned") & F.col("cancellation_reason").isNotNull())
        .groupBy("cancellation_reason")
        .agg(F.count(F.lit(1)).alias("customer_count"))
    )
    total = F.sum("customer_count").over(Window.partitionBy())
    return (
        counts.withColumn("percentage_of_churned", round_ratio(F.col("customer_count"), total, 2, scale=100))
        .orderBy(F.col("customer_count").desc(), "cancellation_reason")
    )


def churn_probability(tables: ChurnTables) -> DataFrame:
    """Per-customer rule-based churn probability (2 decimals)."""
    w = tables.wide
    return w.select(
        "customer_id",
        churn_probability_expr().cast("double").alias("churn_probability"),
    )
