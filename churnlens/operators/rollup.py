"""Segment reports from one mergeable roll-up.

``roll_up`` aggregates records once over all keys that the segment reports group by
(region, plan, age group, reason, tenure, login and billing tiers): its rows are the
combinations of labels that occur, however many customers there are.  All
measures are sums, so roll-ups of disjoint records merge by adding, and
``refresh`` reads only the records that came (and those that went).  The reports
below are then aggregates of that small table, with the same results as over the
records.  Tiers depend on the snapshot day of the records: roll-ups that are
merged must share it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.numeric import exact_ratio, flag, rate_pct, round_ratio
from churnlens.functions.tiers import (
    LOGIN_TIER_EDGES,
    LOGIN_TIER_LABELS,
    TENURE_TIER_EDGES,
    TENURE_TIER_LABELS,
    billing_tier,
    login_tier,
    right_closed_bin,
    tenure_bucket,
)
from churnlens.operators.kpis import revenue
from churnlens.schemas import PLANS

MEASURES = ["n", "flagged", "churned", "logins", "logins_n"]


def _keys() -> dict[str, Column]:
    return {
        "region": F.col("region"), "plan_id": F.col("plan_id"), "plan_name": F.col("plan_name"), "age_group": F.col("age_group"),
        "cancellation_reason": F.when(F.col("is_churned"), F.col("cancellation_reason")),
        "tenure_bucket": tenure_bucket(), "engagement_tier": login_tier(), "billing_issue_tier": billing_tier(),
        "login_class": right_closed_bin("avg_monthly_logins", LOGIN_TIER_EDGES, LOGIN_TIER_LABELS),
        "tenure_class": right_closed_bin("tenure_months", TENURE_TIER_EDGES, TENURE_TIER_LABELS),
    }


def roll_up(records: DataFrame) -> DataFrame:
    """The roll-up of wide records with their ``plan_id``."""
    logins = F.col("avg_monthly_logins").cast("decimal(20,1)")
    rows = records.select(*[c.alias(k) for k, c in _keys().items()], flag("is_churned").cast("bigint").alias("_flag"),
                          logins.alias("_logins"))
    return rows.groupBy(*_keys()).agg(
        F.count(F.lit(1)).alias("n"), F.count("_flag").alias("flagged"), F.coalesce(F.sum("_flag"), F.lit(0)).alias("churned"),
        F.coalesce(F.sum("_logins"), F.lit(0)).cast("decimal(30,1)").alias("logins"), F.count("_logins").alias("logins_n"))


def _total(rolled: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in rolled.schema.fields}
    return rolled.groupBy(*_keys()).agg(*[F.sum(m).cast(kinds[m]).alias(m) for m in MEASURES]).filter("n <> 0")


def merge(*rolled: DataFrame) -> DataFrame:
    """The roll-up of disjoint records, from theirs."""
    return _total(reduce(DataFrame.unionByName, rolled))


def refresh(rolled: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """``rolled`` after records came and went; only these are read."""
    parts = [rolled, roll_up(added)]
    if removed is not None:
        gone = roll_up(removed)
        parts.append(gone.select(*_keys(), *[(-F.col(m)).cast(gone.schema[m].dataType).alias(m) for m in MEASURES]))
    return merge(*parts)


# -- reports ------------------------------------------------------------------

Report = Callable[[DataFrame, DataFrame], DataFrame]


def _rates(r: DataFrame, *keys: str, churned: str = "churned") -> DataFrame:
    return r.groupBy(*keys).agg(F.sum("n").alias("total_customers"), F.sum("churned").alias(churned),
                                rate_pct(F.sum("churned"), F.sum("n")).alias("churn_rate_pct"))


def overall_churn(r: DataFrame, plans: DataFrame) -> DataFrame:
    n, churned = F.coalesce(F.sum("n"), F.lit(0)), F.sum("churned")
    return r.agg(n.alias("total_customers"), churned.alias("total_churned"), (n - churned).alias("total_active"),
                 rate_pct(churned, n).alias("churn_rate_pct"), rate_pct(n - churned, n).alias("retention_rate_pct"))


def churn_by_region_ranked(r: DataFrame, plans: DataFrame) -> DataFrame:
    rates = r.groupBy("region").agg(
        F.sum("n").alias("total_customers"), F.sum("churned").alias("churned"),
        rate_pct(F.sum("churned"), F.sum("n")).alias("churn_rate_pct"), exact_ratio(F.sum("churned"), F.sum("n")).alias("_rate"))
    rank = F.rank().over(Window.orderBy(F.col("_rate").desc_nulls_first())).cast("bigint")  # a row a region
    return rates.withColumn("churn_rank", rank).drop("_rate")


def churn_by_region_plan(r: DataFrame, plans: DataFrame) -> DataFrame:
    return _rates(r.filter("plan_id IS NOT NULL"), "region", "plan_name", churned="churned_count")


def churn_by_login_tier(r: DataFrame, plans: DataFrame) -> DataFrame:
    return r.groupBy("engagement_tier").agg(
        F.sum("n").alias("total_customers"), F.sum("churned").alias("churned"),
        rate_pct(F.sum("churned"), F.sum("n")).alias("churn_rate_pct"),
        round_ratio(F.sum("logins"), F.sum("logins_n"), 1).alias("avg_logins"))


def _by_plan(r: DataFrame, plans: DataFrame, count: Column) -> DataFrame:
    counted = r.groupBy("plan_id").agg(F.sum(count).alias("customers"))
    return counted.filter("customers > 0").join(plans.select("plan_id", "plan_name", "price"), "plan_id")


def mrr_by_plan(r: DataFrame, plans: DataFrame) -> DataFrame:
    active = _by_plan(r, plans, F.col("flagged") - F.col("churned"))
    return active.select(
        "plan_name", F.col("price").cast("double").alias("monthly_price"), F.col("customers").alias("active_subscribers"),
        revenue(F.col("customers"), F.col("price")).alias("monthly_revenue"), F.lit(0.0).alias("churn_rate_pct"))


def revenue_lost_by_plan(r: DataFrame, plans: DataFrame) -> DataFrame:
    lost = _by_plan(r, plans, F.col("churned"))
    return lost.select(
        "plan_name", F.col("customers").alias("churned_customers"),
        revenue(F.col("customers"), F.col("price")).alias("monthly_revenue_lost"),
        revenue(F.col("customers"), F.col("price"), months=12).alias("annualized_revenue_lost"))


def cancellation_reasons(r: DataFrame, plans: DataFrame) -> DataFrame:
    counts = r.filter("cancellation_reason IS NOT NULL").groupBy("cancellation_reason").agg(F.sum("churned").alias("customer_count"))
    total = F.sum("customer_count").over(Window.partitionBy())  # a row a reason
    return counts.withColumn("percentage_of_churned", round_ratio(F.col("customer_count"), total, 2, scale=100))


def _class_rates(key: str) -> Report:
    def report(r: DataFrame, plans: DataFrame) -> DataFrame:
        return r.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("tier")).agg(
            round_ratio(F.sum("churned"), F.sum("flagged"), 6, scale=100).alias("churn_pct"))
    return report


def plan_churn_stats(r: DataFrame, plans: DataFrame) -> DataFrame:
    churned, n = F.sum("churned"), F.sum("flagged")
    return r.filter("plan_name IS NOT NULL").groupBy("plan_name").agg(
        round_ratio(churned, n, 6).alias("churn_rate"), n.alias("total"), round_ratio(churned, n, 6, scale=100).alias("churn_pct"))


def region_churn_ascending(r: DataFrame, plans: DataFrame) -> DataFrame:
    return r.filter("region IS NOT NULL").groupBy("region").agg(
        round_ratio(F.sum("churned"), F.sum("flagged"), 6, scale=100).alias("churn_pct"))


def region_plan_crosstab(r: DataFrame, plans: DataFrame) -> DataFrame:
    def of(plan: str, measure: str) -> Column:
        return F.sum(F.when(F.col("plan_name") == plan, F.col(measure)))
    return r.filter("plan_id IS NOT NULL").groupBy("region").agg(*[
        rate_pct(of(plan, "churned"), of(plan, "n")).alias(plan) for plan, _, _ in PLANS])


REPORTS: dict[str, Report] = {
    "overall_churn": overall_churn,
    "mrr_by_plan": mrr_by_plan,
    "revenue_lost_by_plan": revenue_lost_by_plan,
    "churn_by_region_ranked": churn_by_region_ranked,
    "churn_by_age_group": lambda r, plans: _rates(r, "age_group"),
    "churn_by_tenure_bucket": lambda r, plans: _rates(r, "tenure_bucket"),
    "churn_by_region_plan": churn_by_region_plan,
    "churn_by_login_tier": churn_by_login_tier,
    "churn_by_billing_tier": lambda r, plans: _rates(r, "billing_issue_tier"),
    "cancellation_reasons": cancellation_reasons,
    "login_tier_right_closed": _class_rates("login_class"),
    "tenure_tier_right_closed": _class_rates("tenure_class"),
    "plan_churn_stats": plan_churn_stats,
    "region_churn_ascending": region_churn_ascending,
    "region_plan_crosstab": region_plan_crosstab,
}
