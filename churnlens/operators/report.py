"""Findings frame: headline metrics, top-3 drivers, churn by plan and by region.

The frame is the data of the written findings report, as rows
``(section, ord, item, value)``.  The headline metrics and the per-plan and
per-region rates come from ONE aggregate pass with grouping sets
``((), (plan_name), (region))``; ``grouping_id`` tells the overall row and
the two segment levels apart (and a genuine NULL plan or region from a
rolled-up one).  The correlation drivers are a second one-pass aggregate.
``write_findings`` (sources.files) persists the frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.numeric import exact_ratio, flag, half_even_ratio, round_ratio
from churnlens.operators.statistics import churn_correlation
from churnlens.plans.tables import ChurnTables
from churnlens.schemas import CORRELATION_FEATURES

_SCHEMA_COLS = ["section", "ord", "item", "value"]


# grouping_id over (plan_name, region): a set bit means "rolled up"
_GID_OVERALL, _GID_PLAN, _GID_REGION = 3, 1, 2


def summary_sets(tables: ChurnTables) -> DataFrame:
    """Overall, per-plan and per-region churn counts in one aggregate pass."""
    churned_days = F.when(F.col("is_churned"), F.col("customer_lifetime_days"))
    return tables.wide.groupingSets([[], ["plan_name"], ["region"]], "plan_name", "region").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(flag("is_churned")).alias("churned"),
        F.count("is_churned").alias("flagged"),
        F.sum(churned_days).alias("days_sum"),
        F.count(churned_days).alias("days_n"),
    )


def _sections(sets: DataFrame) -> DataFrame:
    """Turn every grouping-sets row into its report rows with one generator.

    The overall row yields the five headline metrics, a plan row its churn %
    (section churn_by_plan), a region row its churn % (churn_by_region); NULL
    plan / region groups are dropped, as a pandas group-by drops them.  A
    single small window (partitioned by section) numbers the segment rows:
    plans by name, regions by falling rate.  Segment rates are rounded half to
    even, as the report's are; headline figures half away from zero.  Because the branches are not
    separate filters over the aggregate, the aggregate runs once.
    """
    gid = F.col("gid")
    overall = gid == _GID_OVERALL
    plan = (gid == _GID_PLAN) & F.col("plan_name").isNotNull()
    region = (gid == _GID_REGION) & F.col("region").isNotNull()
    rate_pct = half_even_ratio("churned", "flagged", 1, scale=100)
    rate = exact_ratio("churned", "flagged").cast("double")

    def cell(keep, section, ord_, item, value, sort_rate=None):
        return F.struct(
            keep.alias("keep"), F.lit(section).alias("section"), F.lit(ord_).cast("bigint").alias("fixed_ord"),
            item.cast("string").alias("item"), value.cast("double").alias("value"),
            (sort_rate if sort_rate is not None else F.lit(None)).cast("double").alias("sort_rate"),
        )

    cells = F.array(
        cell(overall, "key_metrics", 1, F.lit("total_customers"), F.col("rows")),
        cell(overall, "key_metrics", 2, F.lit("churn_rate_pct"), round_ratio("churned", "rows", 1, scale=100)),
        cell(overall, "key_metrics", 3, F.lit("total_churned"), F.col("churned")),
        cell(overall, "key_metrics", 4, F.lit("avg_lifetime_churned_days"), round_ratio("days_sum", "days_n", 0)),
        cell(overall, "key_metrics", 5, F.lit("avg_lifetime_churned_months"),
             round_ratio("days_sum", F.col("days_n") * F.lit(30), 1)),
        cell(plan, "churn_by_plan", None, F.col("plan_name"), rate_pct),
        cell(region, "churn_by_region", None, F.col("region"), rate_pct, sort_rate=rate),
    )
    rows = sets.select(F.explode(cells).alias("c")).select("c.*").filter("keep")
    number = F.row_number().over(
        Window.partitionBy("section").orderBy(F.col("sort_rate").desc_nulls_last(), F.col("item"))
    )
    return rows.select(
        "section", F.coalesce(F.col("fixed_ord"), number.cast("bigint")).alias("ord"), "item", "value"
    )


def top_drivers(tables: ChurnTables, k: int = 3) -> DataFrame:
    order = Window.orderBy(F.abs("r").desc_nulls_last(), "feature")  # a row a feature
    return (
        churn_correlation(tables.wide, CORRELATION_FEATURES)
        .withColumn("ord", F.row_number().over(order).cast("bigint"))
        .filter(F.col("ord") <= k)
        .select(F.lit("top_drivers").alias("section"), "ord",
                F.col("feature").alias("item"), F.round("r", 4).alias("value"))
    )


def findings(tables: ChurnTables) -> DataFrame:
    parts = [_sections(summary_sets(tables)), top_drivers(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*_SCHEMA_COLS))
    return out.orderBy("section", "ord")
