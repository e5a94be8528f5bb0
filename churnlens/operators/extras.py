"""Figures the reference states in prose but never computes.

* segment lift: a segment's churn rate divided by the overall rate;
* region x plan cross-tab (the "pivot-style" view of the long-form query);
* inactivity flag: users without any event for N days at the data's as-of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.numeric import flag, rate_pct
from churnlens.operators.common import customer_plan
from churnlens.plans.tables import ChurnTables
from churnlens.schemas import PLANS

INACTIVE_DAYS = 7


def segment_lift(tables: ChurnTables, key: str = "region") -> DataFrame:
    """Per segment: churn rate % and its ratio to the overall rate (4 decimals)."""
    c = tables.customers
    # overall churn fraction: a scalar subquery, computed once
    all_rate = c.agg(F.sum(flag("is_churned")).cast("double") / F.count(F.lit(1))).scalar()
    joined = c.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_customers"), F.sum(flag("is_churned")).alias("_churned")
    )
    seg_rate = F.col("_churned").cast("double") / F.col("total_customers")
    lift = F.round(F.try_divide(seg_rate, F.when(all_rate != 0, all_rate)), 4)
    return joined.select(
        F.col(key).alias("segment"),
        "total_customers",
        rate_pct("_churned", "total_customers").alias("churn_rate_pct"),
        lift.alias("lift"),
    ).orderBy(F.col("lift").desc_nulls_last(), "segment")


def region_plan_crosstab(tables: ChurnTables) -> DataFrame:
    """Wide region x plan churn-rate table; one column per plan of the fixed plan list.

    Conditional aggregation over the fixed list: one grouped aggregate (one
    shuffle of partial rows), where ``groupBy().pivot()`` would aggregate twice.
    """
    joined = customer_plan(tables)
    cells = []
    for name, _, _ in PLANS:
        is_plan = F.col("plan_name") == name
        cells.append(
            rate_pct(F.sum(F.when(is_plan, flag("is_churned"))), F.count(F.when(is_plan, F.col("customer_id"))))
            .alias(name)
        )
    return joined.groupBy("region").agg(*cells).orderBy(F.col("region").asc_nulls_last())


def inactive_users(events: DataFrame, days: int = INACTIVE_DAYS) -> DataFrame:
    """Per user: last event date, whole days idle at the as-of date, and the idle flag.

    The as-of date is the latest event date overall (a scalar subquery);
    per-user maxima are a partial + final aggregate, so a user with a third of
    all events is reduced map-side.
    """
    ev = events.select("user_id", F.col("ts").cast("date").alias("d")).filter(F.col("user_id").isNotNull())
    as_of = ev.agg(F.max("d")).scalar()
    last = ev.groupBy("user_id").agg(F.max("d").alias("last_event_date"))
    idle = F.datediff(as_of, F.col("last_event_date"))
    return last.select(
        "user_id",
        "last_event_date",
        idle.cast("bigint").alias("days_inactive"),
        (idle >= days).alias("is_inactive"),
    )
