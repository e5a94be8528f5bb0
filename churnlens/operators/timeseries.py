"""Churn over time: monthly counts with a running total, monthly net growth,
daily counts with a 30-row moving sum (and the 30-calendar-day variant).

Each operator aggregates customers to one row per month or day *before* any
window, so the global (unpartitioned) window only ever sees a calendar's worth
of rows, however many customers there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.dates import month_start
from churnlens.plans.tables import ChurnTables


def _churned_with_date(tables: ChurnTables) -> DataFrame:
    c = tables.customers
    return c.filter(F.col("is_churned") & F.col("cancellation_date").isNotNull())


def monthly_churn_cumulative(tables: ChurnTables) -> DataFrame:
    monthly = (
        _churned_with_date(tables)
        .groupBy(month_start("cancellation_date").alias("churn_month"))
        .agg(F.count(F.lit(1)).alias("customers_churned"))
    )
    running = F.sum("customers_churned").over(
        Window.orderBy("churn_month").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return monthly.withColumn("cumulative_churned", running.cast("bigint")).orderBy("churn_month")


def monthly_net_growth(tables: ChurnTables) -> DataFrame:
    """Sign-ups vs cancellations per month (FULL OUTER JOIN of two monthly aggregates)."""
    signups = (
        tables.customers.groupBy(month_start("join_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("new_customers"))
    )
    churn = (
        _churned_with_date(tables)
        .groupBy(month_start("cancellation_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("churned_customers"))
    )
    s, c = signups.alias("s"), churn.alias("c")
    joined = s.join(c, F.col("s.month") == F.col("c.month"), "full_outer")
    new = F.coalesce(F.col("s.new_customers"), F.lit(0))
    lost = F.coalesce(F.col("c.churned_customers"), F.lit(0))
    return joined.select(
        F.coalesce(F.col("s.month"), F.col("c.month")).alias("month"),
        new.cast("bigint").alias("new_customers"),
        lost.cast("bigint").alias("churned_customers"),
        (new - lost).cast("bigint").alias("net_growth"),
    ).orderBy(F.col("month").asc_nulls_last())


def _daily_churn(tables: ChurnTables) -> DataFrame:
    return (
        _churned_with_date(tables)
        .groupBy(F.col("cancellation_date").cast("date").alias("churn_date"))
        .agg(F.count(F.lit(1)).alias("daily_churned"))
    )


def rolling_30row_churn(tables: ChurnTables) -> DataFrame:
    """Moving sum over the current and 29 preceding *rows* (days without churn have no row)."""
    w = Window.orderBy("churn_date").rowsBetween(-29, Window.currentRow)
    return (
        _daily_churn(tables)
        .withColumn("rolling_30d_churn", F.sum("daily_churned").over(w).cast("bigint"))
        .orderBy("churn_date")
    )


def rolling_30day_calendar(tables: ChurnTables) -> DataFrame:
    """Moving sum over the current and 29 preceding *calendar days*.

    The frame is a RANGE over days since the epoch (``unix_date``), which does
    not depend on the session time zone (a timestamp cast would, across DST).
    """
    w = Window.orderBy(F.unix_date("churn_date")).rangeBetween(-29, Window.currentRow)
    return (
        _daily_churn(tables)
        .withColumn("rolling_30day_churn", F.sum("daily_churned").over(w).cast("bigint"))
        .orderBy("churn_date")
    )
