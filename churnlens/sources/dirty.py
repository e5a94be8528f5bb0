"""Deterministic dirty customer records, the input of the cleaning operators.

Start from the clean wide record; every row is copy 0, rows with
``customer_id % 20 = 0`` get a second copy (bag union).  With
``k = customer_id + 7 * copy`` the defects are placed by residues of ``k``, so
the two copies of a row are damaged differently (and some stop being exact
duplicates), like a real re-delivered batch:

* region NULL            when ``k % 33 = 2``
* plan name lower-case   when ``k % 10 = 3``
* plan price NULL        when ``k % 20 = 8``
* join date MM/dd/yyyy   when ``k % 12 = 4`` (others yyyy-MM-dd)
* cancellation one day before joining, for churned ``customer_id % 13 = 5``

Dates are text, as read from a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.schemas import WIDE_COLUMNS

# Fixed values of the fixture rule.
COPY_EVERY = 20
COPY_SHIFT = 7
REGION_NULL = (33, 2)
PLAN_LOWER = (10, 3)
PRICE_NULL = (20, 8)
SLASH_DATE = (12, 4)
BAD_CANCEL = (13, 5)


def _hit(k: F.Column, rule: tuple[int, int]) -> F.Column:
    return F.pmod(k, F.lit(rule[0])) == rule[1]


def make_dirty(wide: DataFrame) -> DataFrame:
    base = wide.withColumn("_copy", F.lit(0))
    extra = wide.filter(F.pmod(F.col("customer_id"), F.lit(COPY_EVERY)) == 0).withColumn("_copy", F.lit(1))
    rows = base.unionByName(extra)
    k = F.col("customer_id") + F.lit(COPY_SHIFT) * F.col("_copy")
    bad_cancel = F.col("is_churned") & _hit(F.col("customer_id"), BAD_CANCEL)
    cancel = F.when(bad_cancel, F.date_sub(F.col("join_date"), 1)).otherwise(F.col("cancellation_date"))
    out = rows.select(
        "customer_id", "age", "age_group",
        F.when(_hit(k, REGION_NULL), F.lit(None).cast("string")).otherwise(F.col("region")).alias("region"),
        F.when(_hit(k, PLAN_LOWER), F.lower("plan_name")).otherwise(F.col("plan_name")).alias("plan_name"),
        F.when(_hit(k, PRICE_NULL), F.lit(None)).otherwise(F.col("plan_price"))
        .cast(wide.schema["plan_price"].dataType).alias("plan_price"),
        "payment_method",
        F.when(_hit(k, SLASH_DATE), F.date_format("join_date", "MM/dd/yyyy"))
        .otherwise(F.date_format("join_date", "yyyy-MM-dd")).alias("join_date"),
        "tenure_months", "avg_monthly_logins", "avg_session_minutes",
        "support_tickets", "billing_issues_count", "is_churned",
        F.date_format(cancel, "yyyy-MM-dd").alias("cancellation_date"),
        "cancellation_reason", "customer_lifetime_days",
    )
    return out.select(*WIDE_COLUMNS)
