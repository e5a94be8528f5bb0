"""Churn by segment: region (ranked), age, tenure bucket, region x plan, login and
billing tiers (SQL report), and the right-closed chart tiers.

Every segment query is one grouped aggregate on a low-cardinality key: the
partial (map-side) aggregate leaves one row per key per task, so even a key
holding a third of all customers costs no hot partition.  Ranking and ordering
windows run on the aggregated frame only (a handful of rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.numeric import exact_ratio, exact_mean, flag, round_ratio
from churnlens.functions.tiers import (
    BILLING_TIERS,
    LOGIN_TIER_EDGES,
    LOGIN_TIER_LABELS,
    TENURE_TIER_EDGES,
    TENURE_TIER_LABELS,
    billing_tier,
    login_tier,
    right_closed_bin,
    tenure_bucket,
    tenure_bucket_order,
)
from churnlens.operators.common import churn_aggs, churn_by, customer_plan, customer_usage
from churnlens.plans.tables import ChurnTables


def churn_by_region_ranked(tables: ChurnTables) -> DataFrame:
    """Churn per region with RANK() by the unrounded rate (gaps on ties)."""
    agg = tables.customers.groupBy("region").agg(
        *churn_aggs(), exact_ratio(F.sum(flag("is_churned")), F.count(F.lit(1))).alias("_rate")
    )
    rank = F.rank().over(Window.orderBy(F.col("_rate").desc_nulls_first()))
    return (
        agg.withColumn("churn_rank", rank.cast("bigint"))
        .orderBy(F.col("churn_rate_pct").desc_nulls_first(), F.col("region").asc_nulls_last())
        .select("region", "total_customers", "churned", "churn_rate_pct", "churn_rank")
    )


def churn_by_age_group(tables: ChurnTables) -> DataFrame:
    return churn_by(tables.customers, "age_group").orderBy(F.col("age_group").asc_nulls_last())


def churn_by_tenure_bucket(tables: ChurnTables) -> DataFrame:
    """Left-closed tenure buckets (<3, <6, <12, <24, else; NULL -> '2+ years')."""
    agg = churn_by(tables.customers, tenure_bucket("tenure_months").alias("tenure_bucket"))
    return agg.orderBy(tenure_bucket_order("tenure_bucket")).select(
        "tenure_bucket", "total_customers", "churned", "churn_rate_pct"
    )


def churn_by_region_plan(tables: ChurnTables) -> DataFrame:
    """Long-form region x plan churn; counts are joined rows, as in the SQL."""
    return (
        churn_by(customer_plan(tables), "region", "plan_name", count_col="customer_id", churned_name="churned_count")
        .orderBy(F.col("churn_rate_pct").desc_nulls_first(), "region", "plan_name")
    )


def churn_by_login_tier(tables: ChurnTables) -> DataFrame:
    """Left-closed engagement tiers (<3, <8, <15, else; NULL -> High) with mean logins."""
    joined = customer_usage(tables).withColumn("engagement_tier", login_tier("avg_monthly_logins"))
    return (
        joined.groupBy("engagement_tier")
        .agg(*churn_aggs(count_col="customer_id"), exact_mean("avg_monthly_logins", 1).alias("avg_logins"))
        .orderBy(F.col("churn_rate_pct").desc_nulls_first(), "engagement_tier")
    )


def churn_by_billing_tier(tables: ChurnTables) -> DataFrame:
    tier = billing_tier("billing_issues_count").alias("billing_issue_tier")
    return (
        churn_by(customer_usage(tables), tier, count_col="customer_id")
        .orderBy(F.col("churn_rate_pct").desc_nulls_first(), "billing_issue_tier")
    )


# -- chart frames (wide record, right-closed tiers, NULL groups dropped) -----

def _tier_rates(df: DataFrame, tier_col: str) -> DataFrame:
    """Group mean of the churn flag in percent (a NULL flag is skipped, as a mean skips it)."""
    return (
        df.filter(F.col(tier_col).isNotNull())
        .groupBy(tier_col)
        .agg(round_ratio(F.sum(flag("is_churned")), F.count("is_churned"), 6, scale=100).alias("churn_pct"))
    )


def _ordered_labels(spark, labels: list[str]) -> DataFrame:
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)], "tier string, tier_order int")


def _in_label_order(agg: DataFrame, labels: list[str]) -> DataFrame:
    order = F.broadcast(_ordered_labels(agg.sparkSession, labels))
    return agg.join(order, "tier", "inner").orderBy("tier_order").select("tier", "churn_pct")


def login_tier_right_closed(tables: ChurnTables) -> DataFrame:
    """Churn % per ``(0,3], (3,8], (8,15], (15,100]`` login tier; 0 and >100 are unassigned."""
    df = tables.wide.withColumn(
        "tier", right_closed_bin("avg_monthly_logins", LOGIN_TIER_EDGES, LOGIN_TIER_LABELS)
    )
    return _in_label_order(_tier_rates(df, "tier"), LOGIN_TIER_LABELS)


def tenure_tier_right_closed(tables: ChurnTables) -> DataFrame:
    """Churn % per ``(0,3], (3,6], (6,12], (12,24], (24,100]`` tenure tier."""
    df = tables.wide.withColumn(
        "tier", right_closed_bin("tenure_months", TENURE_TIER_EDGES, TENURE_TIER_LABELS)
    )
    return _in_label_order(_tier_rates(df, "tier"), TENURE_TIER_LABELS)


def billing_tier_fixed_domain(tables: ChurnTables) -> DataFrame:
    """Churn % per billing tier in fixed order; a tier without rows appears with NULL."""
    df = tables.wide.withColumn("tier", billing_tier("billing_issues_count"))
    # at most one row per tier: the aggregate is bounded by the three-label domain
    agg = F.broadcast(_tier_rates(df, "tier"))
    domain = _ordered_labels(tables.wide.sparkSession, BILLING_TIERS)
    return domain.join(agg, "tier", "left").orderBy("tier_order").select("tier", "churn_pct")


def plan_churn_stats(tables: ChurnTables) -> DataFrame:
    """Mean churn (fraction), row count and churn % per plan (NULL plan dropped)."""
    w = tables.wide.filter(F.col("plan_name").isNotNull())
    churned, n = F.sum(flag("is_churned")), F.count("is_churned")
    return (
        w.groupBy("plan_name")
        .agg(
            round_ratio(churned, n, 6).alias("churn_rate"),
            n.alias("total"),
            round_ratio(churned, n, 6, scale=100).alias("churn_pct"),
        )
        .orderBy("plan_name")
    )


def region_churn_ascending(tables: ChurnTables) -> DataFrame:
    w = tables.wide.filter(F.col("region").isNotNull())
    churned, n = F.sum(flag("is_churned")), F.count("is_churned")
    return (
        w.groupBy("region")
        .agg(round_ratio(churned, n, 6, scale=100).alias("churn_pct"), exact_ratio(churned, n).alias("_r"))
        .orderBy("_r", "region")
        .select("region", "churn_pct")
    )
