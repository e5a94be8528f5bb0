"""The roll-up: merging, refreshing with what came and went, size, and reports from it alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from churnlens.operators import rollup
from churnlens.plans.catalog import ANALYTICS
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def loaded(spark, cache):
    return cache.get(spark, SF_SMALL)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_merging_parts_equals_the_whole(loaded):
    whole = rollup.roll_up(loaded.records)
    parts = [rollup.roll_up(loaded.records.filter(F.pmod("customer_id", F.lit(3)) == k)) for k in range(3)]
    assert rows(rollup.merge(*parts)) == rows(rollup.merge(parts[2], rollup.merge(parts[0], parts[1]))) == rows(whole)


def test_refresh_adds_and_removes(loaded):
    old = loaded.records.filter("customer_id <= 100")
    new = loaded.records.filter("customer_id > 40")
    refreshed = rollup.refresh(rollup.roll_up(old), loaded.records.filter("customer_id > 100"),
                               loaded.records.filter("customer_id <= 40"))
    assert rows(refreshed) == rows(rollup.roll_up(new))
    nothing = rollup.refresh(rollup.roll_up(old), old.filter("false"), old)
    assert nothing.count() == 0


def test_a_refresh_reads_only_the_new_rows(spark, loaded, tmp_path):
    path = str(tmp_path / "stored")
    rollup.roll_up(loaded.records.filter("customer_id <= 100")).write.parquet(path)
    refreshed = rollup.refresh(spark.read.parquet(path), loaded.records.filter("customer_id > 100"))
    plan = refreshed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "GreaterThan(customer_id,100)" in plan


@pytest.mark.parametrize("name", sorted(rollup.REPORTS))
def test_reports_equal_those_over_the_records(spark, cache, loaded, name):
    rolled, plans = cache.get_rollup(spark, SF_SMALL)
    assert rows(rollup.REPORTS[name](rolled, plans).select(*sorted(ANALYTICS[name](loaded).columns))) \
        == rows(ANALYTICS[name](loaded).select(*sorted(ANALYTICS[name](loaded).columns)))


def test_reports_over_nothing(loaded, spark, cache):
    _, plans = cache.get_rollup(spark, SF_SMALL)
    empty = rollup.roll_up(loaded.records.filter("false"))
    for name, report in rollup.REPORTS.items():
        assert report(empty, plans).count() == (1 if name == "overall_churn" else 0), name


def test_the_rollup_grows_with_labels_not_rows(loaded):
    copies = loaded.records.withColumn("customer_id", F.explode(F.sequence(F.lit(1), F.lit(20))))
    assert rollup.roll_up(copies).count() == rollup.roll_up(loaded.records).count()
