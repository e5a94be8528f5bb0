"""Relational tables with known violations of every declared constraint.

As the dirty records are for cleaning, these tables are for the constraint
checks: a copy of the loaded records in which the residue of the customer id
modulo 50 decides which cell is wrong.  The relations are damaged one by one, so
foreign keys can point nowhere.  All of them come from one scan of the records.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.operators.audit import RELATIONS, intake
from churnlens.plans.tables import ChurnTables

RESIDUES = 50
LONG_PRICE = "decimal(10,3)"
LONG_METRIC = "decimal(18,2)"


def _damaged(row: str, columns: list[str], faults: dict[str, dict[int, Column]]) -> Column:
    """The struct ``row`` with the named cells replaced in the records of the given residues."""
    residue = F.pmod("record_id", F.lit(RESIDUES))
    cells = []
    for name in columns:
        cell = F.col(f"{row}.{name}")
        for r, value in faults.get(name, {}).items():
            cell = F.when(residue == r, value).otherwise(cell)
        cells.append(cell.alias(name))
    return F.when(F.col(row).isNotNull(), F.struct(*cells))


def _longer(row: str, columns: list[str], kinds: dict[str, str]) -> Column:
    """The struct ``row`` with some decimals widened, so that they can hold values too long for the schema."""
    cells = [F.col(f"{row}.{c}").cast(kinds[c]).alias(c) if c in kinds else F.col(f"{row}.{c}").alias(c) for c in columns]
    return F.when(F.col(row).isNotNull(), F.struct(*cells))


def _text(letter: str, length: int) -> Column:
    return F.repeat(F.lit(letter), length)


def faulty_intake(t: ChurnTables) -> DataFrame:
    """The records of a loaded bundle as rows of the relations, with damaged cells and repeated customers."""
    whole = intake(t.records)
    columns = {r: whole.schema[r].dataType.names for r in RELATIONS}
    none = F.lit(None)
    widened = whole.withColumns({
        "subscriptions": _longer("subscriptions", columns["subscriptions"], {"plan_price": LONG_PRICE}),
        "usage_metrics": _longer("usage_metrics", columns["usage_metrics"], {
            "avg_monthly_logins": LONG_METRIC, "avg_session_minutes": LONG_METRIC}),
    })
    customer, subscription, metric = (F.col(c) for c in (
        "customers.customer_id", "subscriptions.subscription_id", "usage_metrics.metric_id"))
    damaged = widened.withColumns({
        "customers": _damaged("customers", columns["customers"], {
            "customer_id": {1: none, 2: customer - 1},
            "age": {3: F.lit(17), 4: F.lit(101), 5: F.lit(40000)},
            "age_group": {6: _text("a", 11)},
            "region": {7: _text("r", 31)},
            "payment_method": {8: _text("p", 31)},
            "join_date": {9: none},
            "tenure_months": {10: F.lit(-40000)},
            "is_churned": {11: none},
            "cancellation_date": {12: F.date_sub(F.col("customers.join_date"), 1)},
            "cancellation_reason": {13: _text("c", 101)},
        }),
        "subscriptions": _damaged("subscriptions", columns["subscriptions"], {
            "subscription_id": {31: subscription - 1},
            "customer_id": {15: none, 16: -customer},
            "plan_id": {17: none, 18: F.lit(9)},
            "plan_name": {19: _text("n", 51)},
            "plan_price": {20: none, 21: F.lit("12345.678").cast(LONG_PRICE)},
            "start_date": {22: none},
            "end_date": {23: F.date_sub(F.col("subscriptions.start_date"), 1)},
            "is_active": {24: none},
        }),
        "usage_metrics": _damaged("usage_metrics", columns["usage_metrics"], {
            "metric_id": {32: metric - 1},
            "customer_id": {25: none, 26: -customer},
            "support_tickets": {27: F.lit(40000)},
            "billing_issues_count": {28: F.lit(40000)},
            "avg_monthly_logins": {29: F.lit("10000.25").cast(LONG_METRIC)},
            "avg_session_minutes": {30: F.lit("100000.25").cast(LONG_METRIC)},
        }),
    })
    # a second row for some customers: one more element, unfolded in the same scan
    again = F.struct("record_id", "customers", F.lit(None).cast(damaged.schema["subscriptions"].dataType).alias("subscriptions"),
                     F.lit(None).cast(damaged.schema["usage_metrics"].dataType).alias("usage_metrics"))
    once = F.struct("record_id", "customers", "subscriptions", "usage_metrics")
    twice = F.pmod("record_id", F.lit(RESIDUES)) == 14
    return damaged.select(F.inline(F.when(twice, F.array(once, again)).otherwise(F.array(once))))


def faulty_plans(t: ChurnTables) -> DataFrame:
    seeded = t.subscription_plans.select("plan_id", "plan_name", F.col("price").cast(LONG_PRICE).alias("price"))
    bad = F.array(*[
        F.struct(F.lit(i).cast("int").alias("plan_id"), name.cast("string").alias("plan_name"),
                 F.lit(price).cast(LONG_PRICE).alias("price"))
        for i, name, price in ((3, F.lit("Premium"), "0"), (5, F.lit(None), "12345.678"), (6, _text("plan ", 11), None))
    ])
    return seeded.unionByName(t.wide.sparkSession.range(1).select(F.inline(bad)))


def faulty_tables(t: ChurnTables, damaged: DataFrame | None = None, plans: DataFrame | None = None) -> ChurnTables:
    """The relations of the damaged records (written before, or made here), and plans with three bad rows."""
    damaged = faulty_intake(t) if damaged is None else damaged
    return replace(t, subscription_plans=faulty_plans(t) if plans is None else plans,
                   **{r: damaged.filter(F.col(r).isNotNull()).select(f"{r}.*") for r in RELATIONS})
