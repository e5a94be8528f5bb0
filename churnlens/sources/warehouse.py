"""Load the wide record into the plan / customer / subscription / usage schema.

S3-S5 are projections of the wide record; S4 joins the plan lookup, which the
seeded literal relation lets Catalyst broadcast by its known size.  Surrogate
keys and load times are given when a load is written (``plans.loads``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.schemas import (
    CUSTOMER_COLUMNS,
    PLANS,
    PLANS_SCHEMA,
    SUBSCRIPTION_COLUMNS,
    USAGE_COLUMNS,
)


# Declared column defaults of the relational schema (value, type); a column
# omitted from the loaded input takes its default, as an INSERT that omits it would.
COLUMN_DEFAULTS = {
    "customers": {"is_churned": (False, "boolean")},
    "subscriptions": {"is_active": (True, "boolean")},
    "usage_metrics": {"support_tickets": (0, "bigint"), "billing_issues_count": (0, "bigint")},
}


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Add every defaulted column of ``table`` that ``df`` lacks, with its default value."""
    out = df
    for column, (value, dtype) in COLUMN_DEFAULTS.get(table, {}).items():
        if column not in out.columns:
            out = out.withColumn(column, F.lit(value).cast(dtype))
    return out


def plans_frame(spark: SparkSession) -> DataFrame:
    """The seeded plan lookup, ``plan_id`` 1..3 in seed order."""
    rows = F.array(*[
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip((i, *plan), PLANS_SCHEMA.fields)])
        for i, plan in enumerate(PLANS, start=1)
    ])
    # one literal row unfolded: Catalyst knows its size (the outer form keeps the columns nullable)
    return spark.range(1).select(F.inline_outer(rows))


def load_customers(wide: DataFrame) -> DataFrame:
    """S3: customer projection of the wide record (omitted defaulted columns filled)."""
    return with_defaults(wide, "customers").select(*CUSTOMER_COLUMNS)


def load_subscriptions(wide: DataFrame, plans: DataFrame) -> DataFrame:
    """One subscription per wide row whose plan name is in the lookup (inner join)."""
    lookup = plans.select("plan_id", F.col("plan_name").alias("_lookup_name"))
    joined = wide.join(lookup, wide["plan_name"] == lookup["_lookup_name"], "inner")
    return joined.select(
        "customer_id",
        "plan_id",
        "plan_name",
        "plan_price",
        F.col("join_date").alias("start_date"),
        F.col("cancellation_date").alias("end_date"),
        (~F.col("is_churned")).alias("is_active"),
    ).select(*SUBSCRIPTION_COLUMNS)


def load_usage_metrics(wide: DataFrame) -> DataFrame:
    """Usage projection of the wide record (omitted defaulted columns filled)."""
    return with_defaults(wide, "usage_metrics").select(*USAGE_COLUMNS)


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """Names of the tables of a database, sorted."""
    return spark.sql(f"SHOW TABLES IN {database}").select(F.col("tableName").alias("table_name")).orderBy(
        "table_name"
    )
