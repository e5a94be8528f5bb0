"""Declared constraints of the relational schema, checked as violation counts.

Each check returns ``(constraint_name, violations)`` rows.  CHECK constraints pass
on NULL (only a FALSE predicate is a violation), as in SQL.  All checks on one
table share one aggregate pass; keys use a grouped count, foreign keys a
left-anti join of the distinct keys.  The predicates themselves are shared with
``operators.audit``, which finds the broken rows of all relations in one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.plans.tables import ChurnTables
from churnlens.schemas import NUMERIC_WIDTHS, SMALLINT_COLUMNS, VARCHAR_WIDTHS

NOT_NULL = {
    "subscription_plans": ["plan_name", "price"],
    "customers": ["customer_id", "join_date", "is_churned"],
    "subscriptions": ["customer_id", "plan_id", "plan_price", "start_date", "is_active"],
    "usage_metrics": ["customer_id"],
}


def _tables(t: ChurnTables) -> dict[str, DataFrame]:
    return {
        "subscription_plans": t.subscription_plans,
        "customers": t.customers,
        "subscriptions": t.subscriptions,
        "usage_metrics": t.usage_metrics,
    }


def _counts(df: DataFrame, checks: dict[str, F.Column]) -> DataFrame:
    """One aggregate pass: number of rows where each violation predicate is TRUE."""
    one = df.agg(*[
        F.coalesce(F.sum(F.coalesce(pred, F.lit(False)).cast("bigint")), F.lit(0)).alias(f"c{i}")
        for i, pred in enumerate(checks.values())
    ])
    cells = F.array(*[
        F.struct(F.lit(name).alias("constraint_name"), F.col(f"c{i}").cast("bigint").alias("violations"))
        for i, name in enumerate(checks)
    ])
    return one.select(F.explode(cells).alias("x")).select("x.*")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _duplicate_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    dup = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return dup.agg(F.count(F.lit(1)).cast("bigint").alias("violations")).select(
        F.lit(name).alias("constraint_name"), "violations"
    )


def check_primary_key(t: ChurnTables) -> DataFrame:
    """K1: key values held by more than one row (NULL keys counted by the NOT NULL check).

    The surrogate keys are those that the load stored; tables that were not
    loaded hold none, so nothing can be repeated there.
    """
    frames = [
        _duplicate_keys(t.customers, "customer_id", "customers.customer_id PRIMARY KEY"),
        _duplicate_keys(t.subscription_plans, "plan_id", "subscription_plans.plan_id PRIMARY KEY"),
        _duplicate_keys(t.subscription_plans, "plan_name", "subscription_plans.plan_name UNIQUE"),
    ]
    for table, df, key in (("subscriptions", t.subscriptions, "subscription_id"),
                           ("usage_metrics", t.usage_metrics, "metric_id")):
        stored = df if key in df.columns else df.withColumn(key, F.lit(None).cast("bigint"))
        frames.append(_duplicate_keys(stored, key, f"{table}.{key} PRIMARY KEY"))
    return _union(frames)


Cell = Callable[[str], F.Column]


def not_null_checks(table: str, at: Cell = F.col) -> dict[str, F.Column]:
    return {f"{table}.{c} NOT NULL": at(c).isNull() for c in NOT_NULL.get(table, [])}


def range_checks(table: str, at: Cell = F.col) -> dict[str, F.Column]:
    if table == "subscription_plans":
        return {"subscription_plans.price > 0": ~(at("price") > 0)}
    return {"customers.age BETWEEN 18 AND 100": ~at("age").between(18, 100)} if table == "customers" else {}


def order_checks(table: str, at: Cell = F.col) -> dict[str, F.Column]:
    if table == "customers":
        return {"customers.chk_cancellation_after_join": at("cancellation_date") < at("join_date")}
    return {"subscriptions.chk_end_after_start": at("end_date") < at("start_date")} if table == "subscriptions" else {}


def _fits_numeric(col: F.Column, precision: int, scale: int) -> F.Column:
    """Violation: more integer digits than ``precision - scale`` or more than ``scale`` decimals."""
    too_wide = F.abs(col) >= F.lit(10 ** (precision - scale))
    too_fine = F.round(col, scale) != col
    return col.isNotNull() & (too_wide | too_fine)


def width_checks(table: str, at: Cell = F.col) -> dict[str, F.Column]:
    checks = {f"{table}.{c} VARCHAR({n})": F.length(at(c)) > n for c, n in VARCHAR_WIDTHS.get(table, {}).items()}
    for c in SMALLINT_COLUMNS.get(table, []):
        checks[f"{table}.{c} SMALLINT"] = at(c).isNotNull() & at(c).try_cast("smallint").isNull()
    for c, (p, s) in NUMERIC_WIDTHS.get(table, {}).items():
        checks[f"{table}.{c} NUMERIC({p},{s})"] = _fits_numeric(at(c), p, s)
    return checks


ROW_CHECKS = (not_null_checks, range_checks, order_checks, width_checks)


def _check_rows(t: ChurnTables, checks: Callable[[str], dict[str, F.Column]]) -> DataFrame:
    return _union([_counts(df, found) for table, df in _tables(t).items() if (found := checks(table))])


def check_not_null(t: ChurnTables) -> DataFrame:
    """K2: NULLs in NOT NULL columns (including primary keys)."""
    return _check_rows(t, not_null_checks)


def check_range(t: ChurnTables) -> DataFrame:
    """K3: price > 0; age BETWEEN 18 AND 100 (NULL passes)."""
    return _check_rows(t, range_checks)


def check_date_order(t: ChurnTables) -> DataFrame:
    """K4: cancellation_date >= join_date; end_date >= start_date (NULL passes)."""
    return _check_rows(t, order_checks)


def check_width(t: ChurnTables) -> DataFrame:
    """K5: VARCHAR(n) lengths, SMALLINT range, NUMERIC(p,s) precision and scale."""
    return _check_rows(t, width_checks)


def _orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    # one row a key on both sides, so a key with many rows is reduced before the join
    keys = parent.select(key).filter(F.col(key).isNotNull()).distinct()
    rows = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    missing = rows.join(keys, key, "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(name).alias("constraint_name"), "violations"
    )


def check_foreign_key(t: ChurnTables) -> DataFrame:
    """K6: child rows whose key has no parent row."""
    return _union([
        _orphans(t.subscriptions, t.customers, "customer_id", "subscriptions.customer_id -> customers"),
        _orphans(t.subscriptions, t.subscription_plans, "plan_id",
                 "subscriptions.plan_id -> subscription_plans"),
        _orphans(t.usage_metrics, t.customers, "customer_id", "usage_metrics.customer_id -> customers"),
    ])
