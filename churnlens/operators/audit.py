"""One audit of all relations: records split into accepted and rejected ones.

A record becomes a row of customers, of subscriptions (where its plan is known) and of
usage_metrics.  ``intake`` lays the three rows side by side, so one scan
evaluates every declared row constraint (K2-K5); each record gets the array
``broken`` of the constraints that it breaks, in the order of their declaration.
Keys need the other records: ids held by several records (K1) and references
without a parent (K6) come from grouped counts of slim key columns and are
joined back by key, one row a key on the parents' side, so a hot key is split
like any skewed join.

A record that breaks anything is rejected as a whole: its relations refer to
each other.  All records of a repeated id are rejected, none is chosen.  NULLs
pass every constraint but NOT NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.operators.constraints import ROW_CHECKS
from churnlens.schemas import CUSTOMER_COLUMNS, USAGE_COLUMNS

RELATIONS = ("customers", "subscriptions", "usage_metrics")
REPEATED_ID = "customers.customer_id PRIMARY KEY"
NO_CUSTOMER = {"subscriptions": "subscriptions.customer_id -> customers",
               "usage_metrics": "usage_metrics.customer_id -> customers"}
NO_PLAN = "subscriptions.plan_id -> subscription_plans"


def row_structs(records: DataFrame) -> list[Column]:
    """The rows of the three relations that wide records with their ``plan_id`` become."""
    def keyed(key: str) -> list[Column]:
        return [F.col(key)] if key in records.columns else []

    subscription = F.struct(
        *keyed("subscription_id"), F.col("customer_id"), F.col("plan_id"), F.col("plan_name"), F.col("plan_price"),
        F.col("join_date").alias("start_date"), F.col("cancellation_date").alias("end_date"),
        (~F.col("is_churned")).alias("is_active"))
    return [F.struct(*CUSTOMER_COLUMNS).alias("customers"),
            F.when(F.col("plan_id").isNotNull(), subscription).alias("subscriptions"),
            F.struct(*keyed("metric_id"), *USAGE_COLUMNS).alias("usage_metrics")]


def intake(records: DataFrame) -> DataFrame:
    """(record_id, customers, subscriptions, usage_metrics) of wide records with their ``plan_id``.

    The surrogate keys are part of their rows where the records hold them.
    """
    return records.select(F.col("customer_id").alias("record_id"), *row_structs(records))


def row_constraints() -> dict[str, tuple[str, Column]]:
    """Every row constraint of the three relations: name -> (relation, violated)."""
    return {name: (r, violated) for r in RELATIONS for checks in ROW_CHECKS
            for name, violated in checks(r, lambda c, r=r: F.col(f"{r}.{c}")).items()}


def _names(conditions: dict[str, Column]) -> Column:
    """The names whose condition is TRUE, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))


def with_broken_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (an intake) with the array ``broken`` of their broken row constraints."""
    return rows.withColumn("broken", _names({
        name: F.col(r).isNotNull() & violated for name, (r, violated) in row_constraints().items()}))


def with_repeated_ids(audited: DataFrame) -> DataFrame:
    """Adds the primary key to ``broken`` where several records hold the customer id."""
    key = F.col("customers.customer_id")
    repeated = audited.filter(key.isNotNull()).groupBy(key.alias("_id")).agg(F.count(F.lit(1)).alias("n")) \
        .filter("n > 1").select("_id")
    return _add(audited.join(repeated, key == F.col("_id"), "left"), REPEATED_ID, F.col("_id").isNotNull()).drop("_id")


def with_missing_parents(audited: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds the foreign keys to ``broken`` whose parent row is missing."""
    customer = F.col("customers.customer_id")
    parents = audited.filter(customer.isNotNull()).select(customer.alias("_id")).distinct()
    for relation, name in NO_CUSTOMER.items():
        child = F.col(f"{relation}.customer_id")
        audited = _add(audited.join(parents, child == F.col("_id"), "left"), name,
                       child.isNotNull() & F.col("_id").isNull()).drop("_id")
    known = plans.filter("plan_id IS NOT NULL").select(F.col("plan_id").alias("_plan")).distinct()
    child = F.col("subscriptions.plan_id")
    return _add(audited.join(known, child == F.col("_plan"), "left"), NO_PLAN,
                child.isNotNull() & F.col("_plan").isNull()).drop("_plan")


def _add(audited: DataFrame, name: str, condition: Column) -> DataFrame:
    return audited.withColumn("broken", F.concat("broken", _names({name: condition})))


def audit(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """An intake with all broken constraints of each record."""
    return with_missing_parents(with_repeated_ids(with_broken_rows(rows)), plans)


def accepted(audited: DataFrame) -> DataFrame:
    return audited.filter(F.size("broken") == 0).drop("broken")


def rejects(audited: DataFrame) -> DataFrame:
    """The rejected records, with what they break."""
    return audited.filter(F.size("broken") > 0)


def audit_counts(audited: DataFrame) -> DataFrame:
    """(constraint_name, violations) of the row constraints and foreign keys, zeros included: one aggregate."""
    names = [*row_constraints(), *NO_CUSTOMER.values(), NO_PLAN]
    one = audited.agg(*[F.sum(F.array_contains("broken", n).cast("bigint")).alias(f"c{i}") for i, n in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(n).alias("constraint_name"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("violations"))
                      for i, n in enumerate(names)])
    return one.select(F.inline(cells))
