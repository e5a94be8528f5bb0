"""Loads: stable gapless keys, replacing in one step, loads that die on the way, reopening."""

from __future__ import annotations

import os
import signal
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from churnlens.plans.loads import Warehouse
from churnlens.plans.numbering import gapless
from churnlens.plans.tables import ChurnTables
from tests.conftest import ROOT, SF_SMALL


def keys(tables):
    rows = tables.customers.select("customer_id").join(tables.subscriptions.select("customer_id", "subscription_id"), "customer_id", "left") \
        .join(tables.usage_metrics.select("customer_id", "metric_id"), "customer_id").collect()
    return {r.customer_id: (r.subscription_id, r.metric_id) for r in rows}


def part(tables, condition):
    return ChurnTables.from_wide(tables.wide.filter(condition))


@pytest.fixture()
def warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "warehouse"))
    yield w
    w.drop()


def test_first_load_numbers_customers_in_order(warehouse, small_tables):
    loaded = warehouse.load(ChurnTables.from_wide(small_tables.wide))
    ids = sorted(keys(loaded))
    assert keys(loaded) == {c: (n, n) for n, c in enumerate(ids, 1)}


@pytest.mark.parametrize("unique_key", [True, False])
def test_a_load_derives_its_records_once(spark, warehouse, small_tables, unique_key):
    derived = spark.sparkContext.accumulator(0)

    def seen(customer_id):
        derived.add(1)
        return customer_id

    wide = small_tables.wide.withColumn("customer_id", F.udf(seen, "bigint")("customer_id"))
    loaded = warehouse.load(ChurnTables.from_wide(wide), unique_key=unique_key)
    assert derived.value == small_tables.wide.count() == loaded.records.count()


def test_a_load_of_a_written_table_gives_the_same_keys(warehouse, small_tables):
    written = keys(warehouse.load(ChurnTables.from_wide(small_tables.wide), written=True))
    assert keys(warehouse.load(ChurnTables.from_wide(small_tables.wide))) == written


def test_repeated_load_keeps_keys_and_the_next_continues(warehouse, small_tables):
    first = keys(warehouse.load(part(small_tables, "customer_id % 3 <> 0")))
    assert keys(warehouse.load(part(small_tables, "customer_id % 3 <> 0"))) == first
    everything = keys(warehouse.load(ChurnTables.from_wide(small_tables.wide)))
    assert {c: k for c, k in everything.items() if c in first} == first
    new = sorted(set(everything) - set(first))
    assert [everything[c] for c in new] == [(n, n) for n in range(len(first) + 1, len(first) + len(new) + 1)]


def test_numbers_of_rows_that_went_are_not_given_again(warehouse, small_tables):
    first = keys(warehouse.load(ChurnTables.from_wide(small_tables.wide)))
    kept = keys(warehouse.load(part(small_tables, "customer_id < 50")))
    assert kept == {c: k for c, k in first.items() if c < 50}
    back = keys(warehouse.load(part(small_tables, "customer_id < 50 OR customer_id > 140")))
    assert min(n for c, (n, _) in back.items() if c > 140) == len(first) + 1


def test_customers_without_a_known_plan(warehouse, make_tables):
    rows = [{"customer_id": i, "plan_name": None if i % 2 else "Basic", "is_churned": False} for i in range(1, 9)]
    loaded = warehouse.load(make_tables(rows))
    assert keys(loaded) == {i: (None if i % 2 else i // 2, i) for i in range(1, 9)}
    assert loaded.subscriptions.count() == 4
    # a plan that becomes known gives the next number, a plan that goes takes it away
    rows = [{"customer_id": i, "plan_name": "Basic" if i in (1, 2) else None, "is_churned": False} for i in range(1, 9)]
    again = keys(warehouse.load(make_tables(rows)))
    assert again[1] == (5, 1) and again[2] == (1, 2) and again[4] == (None, 4)


def test_load_times_and_defaults(spark, warehouse):
    wide = spark.createDataFrame([(1, "Basic"), (2, "Premium")], "customer_id long, plan_name string")
    full = spark.createDataFrame([], Warehouse(spark, "/none").history().schema)  # no load yet
    assert full.count() == 0 and warehouse.current() is None
    from churnlens.schemas import WIDE_SCHEMA
    defaulted = ("is_churned", "support_tickets", "billing_issues_count")
    for f in WIDE_SCHEMA.fields:
        if f.name not in wide.columns and f.name not in defaulted:
            wide = wide.withColumn(f.name, F.lit(None).cast(f.dataType))
    plans = ChurnTables.from_wide(wide.withColumn("is_churned", F.lit(False)))
    from dataclasses import replace
    loaded = warehouse.load(replace(plans, wide=wide))
    assert [(r.is_churned, r.created_at is not None) for r in loaded.customers.collect()] == [(False, True)] * 2
    assert [(r.support_tickets, r.billing_issues_count, r.recorded_at is not None) for r in loaded.usage_metrics.collect()] \
        == [(0, 0, True)] * 2
    assert all(r.is_active for r in loaded.subscriptions.collect())
    stamps = {r[0] for df, c in ((loaded.customers, "created_at"), (loaded.usage_metrics, "recorded_at"),
                                 (loaded.subscription_plans, "created_at")) for r in df.select(c).collect()}
    assert stamps == {warehouse.history().first().loaded_at}


def test_repeated_or_absent_ids_fail_and_leave_nothing(spark, warehouse, make_tables):
    for rows in ([{"customer_id": 1}, {"customer_id": 1}], [{"customer_id": None}, {"customer_id": 2}]):
        before = {d.name for d in spark.catalog.listDatabases()}
        with pytest.raises(ValueError, match="primary key"):
            warehouse.load(make_tables(rows))
        assert warehouse.current() is None and warehouse.vacuum() == []
        assert {d.name for d in spark.catalog.listDatabases()} == before


def test_a_failing_load_leaves_the_former_tables(spark, warehouse, small_tables, monkeypatch):
    former = keys(warehouse.load(part(small_tables, "customer_id < 100")))
    for step in ("_write_plans", "_write_records", "_commit"):
        with monkeypatch.context() as m:
            def fail(*args, **kwargs):
                raise OSError("disk gone")
            m.setattr(Warehouse, step, fail)
            with pytest.raises(OSError):
                warehouse.load(ChurnTables.from_wide(small_tables.wide))
        assert keys(warehouse.current()) == former
    assert warehouse.vacuum() == []


KILLED = """
import os, signal, sys
from churnlens.plans.loads import Warehouse
from churnlens.plans.tables import ChurnTables
from churnlens.session import build_session
root, sf_dir = sys.argv[1:]
spark = build_session(master="local[2]", shuffle_partitions=2)
warehouse = Warehouse(spark, root)
tables = ChurnTables.derive(spark, sf_dir)
warehouse.load(ChurnTables.from_wide(tables.wide.filter("customer_id < 60")))
written = Warehouse._write_records
def write_and_die(self, *args):
    written(self, *args)
    os.kill(os.getpid(), signal.SIGKILL)
Warehouse._write_records = write_and_die
warehouse.load(tables)
"""


def test_a_killed_load_leaves_the_former_tables(spark, tmp_path):
    """A process killed between its tables and the commit; another session opens what it had committed before."""
    root = str(tmp_path / "killed")
    done = subprocess.run([sys.executable, "-c", KILLED, root, SF_SMALL], cwd=ROOT, capture_output=True, timeout=300,
                          env={**os.environ, "PYTHONPATH": ROOT})
    assert done.returncode == -signal.SIGKILL, done.stderr.decode()[-2000:]
    warehouse = Warehouse(spark, root)
    tables = warehouse.current()
    expected = ChurnTables.derive(spark, SF_SMALL).wide.filter("customer_id < 60")
    assert sorted(keys(tables)) == sorted(r[0] for r in expected.select("customer_id").collect())
    assert tables.wide.exceptAll(expected).count() == 0
    plan = tables.customers.join(tables.usage_metrics.hint("merge"), "customer_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # reopened with its buckets
    assert len(warehouse.vacuum()) == 1 and sorted(keys(warehouse.current())) == sorted(keys(tables))
    next_load = keys(warehouse.load(ChurnTables.derive(spark, SF_SMALL)))
    assert {c: k for c, k in next_load.items() if c < 60} == keys(tables)
    warehouse.drop()


def test_readers_keep_the_load_they_opened(warehouse, small_tables):
    old = warehouse.load(part(small_tables, "customer_id < 100"))
    n = old.customers.count()
    new = warehouse.load(ChurnTables.from_wide(small_tables.wide))
    assert old.customers.count() == n == old.usage_metrics.count() and new.customers.count() == 150
    assert [r.load_id for r in warehouse.history().orderBy("load_id").collect()] == [1, 2]
    assert len(warehouse.vacuum()) == 1 and warehouse.current().customers.count() == 150


def test_rows_without_a_unique_id_are_numbered_one_by_one(warehouse, make_tables):
    rows = [{"customer_id": 7, "plan_name": "Basic", "age": n} for n in range(5)] + [{"customer_id": None}, {"customer_id": 1, "plan_name": "x"}]
    loaded = warehouse.load(make_tables(rows), unique_key=False)
    numbers = [(r.customer_id, r.age, r.subscription_id, r.metric_id) for r in loaded.records.collect()]
    assert sorted(numbers, key=lambda r: r[3]) == [(1, None, None, 1), *[(7, n, n + 1, n + 2) for n in range(5)], (None, None, None, 7)]


def test_rejects_are_kept_apart_with_what_they_break(warehouse, make_tables):
    from datetime import date
    from decimal import Decimal
    good = {"plan_name": "Basic", "plan_price": Decimal("9.99"), "join_date": date(2023, 1, 1), "is_churned": False, "age": 30}
    rows = [{**good, "customer_id": 1}, {**good, "customer_id": 2, "age": 17}, {**good, "customer_id": 3}, {**good, "customer_id": 3},
            {**good, "customer_id": None}, {**good, "customer_id": 4, "cancellation_date": date(2022, 1, 1), "region": "r" * 31},
            {**good, "customer_id": 5, "plan_name": "none", "plan_price": None}, {**good, "customer_id": 6, "plan_price": None}]
    loaded = warehouse.load(make_tables(rows), reject=True)
    assert keys(loaded) == {1: (1, 1), 5: (None, 2)}  # an unknown plan is no violation: there is no subscription to break
    broken = sorted((r.customer_id or 0, tuple(r.broken)) for r in warehouse.rejects().collect())
    assert broken == [
        (0, ("customers.customer_id NOT NULL", "subscriptions.customer_id NOT NULL", "usage_metrics.customer_id NOT NULL")),
        (2, ("customers.age BETWEEN 18 AND 100",)),
        (3, ("customers.customer_id PRIMARY KEY",)), (3, ("customers.customer_id PRIMARY KEY",)),
        (4, ("customers.chk_cancellation_after_join", "customers.region VARCHAR(30)", "subscriptions.chk_end_after_start")),
        (6, ("subscriptions.plan_price NOT NULL",))]
    assert warehouse.history().first().rejected == 6
    warehouse.load(make_tables(rows[:1]), reject=True)
    assert warehouse.rejects() is None


def test_audit_reads_the_records_once(spark, cache):
    from churnlens.operators.audit import audit_counts, with_broken_rows
    from churnlens.sources.faulty import faulty_intake
    plan = audit_counts(with_broken_rows(faulty_intake(cache.get(spark, SF_SMALL))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_gapless_numbers_with_a_hot_value_over_many_tasks(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 3 % 2).alias("k"), "id").repartition(13)
    names = iter(range(100))

    def stage(df, name):
        path = str(tmp_path / f"{name}{next(names)}")
        df.write.parquet(path)
        return spark.read.parquet(path)
    out = gapless(rows, [F.col("k"), F.col("id")], {"n": (F.lit(True), 5), "odd": (F.col("id") % 2 == 1, 0)}, stage)
    got = sorted((r.n, r.k, r.id, r.odd) for r in out.collect())
    expected = sorted((i % 3 % 2, i) for i in range(20_000))
    assert [(n, k, i) for n, k, i, _ in got] == [(n + 6, *row) for n, row in enumerate(expected)]
    assert [o for *_, o in got if o is not None] == list(range(1, 10_001))
    assert all((o is not None) == (i % 2 == 1) for _, _, i, o in got)
    assert gapless(rows.filter("false"), [F.col("id")], {"n": (F.lit(True), 0)}, stage).count() == 0
