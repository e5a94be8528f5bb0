"""Session and cache helpers."""

from __future__ import annotations

import shutil
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from churnlens.operators import kpis
from churnlens.plans.catalog import CONSTRAINTS, TableCache
from churnlens.session import checkpoint_root
from tests.conftest import SF_SMALL


def test_cache_loads_once_and_reloads_after_catalog_loss(spark):
    cache = TableCache()
    first = cache.get(spark, SF_SMALL)
    assert cache.get(spark, SF_SMALL) is first
    spark.sql(f"DROP DATABASE {first.database} CASCADE")
    second = cache.get(spark, SF_SMALL)
    assert second.database != first.database
    assert second.customers.count() == 150


def test_tables_live_below_the_checkpoint_root(spark, small_tables):
    root = checkpoint_root(spark)
    location = spark.sql(f"DESCRIBE DATABASE {small_tables.database}").filter("info_name = 'Location'").first()
    assert location.info_value.replace("file:", "").startswith(root.replace("file:", ""))


def test_bucket_count_setting(spark):
    from churnlens.plans.loads import BUCKET_BYTES, BUCKETS_CONF, ROW_BYTES, bucket_count
    spark.conf.set(BUCKETS_CONF, "13")
    try:
        assert bucket_count(spark, 10) == 13
        assert bucket_count(spark, 10, 5) == 5
    finally:
        spark.conf.unset(BUCKETS_CONF)
    assert bucket_count(spark, 0) == bucket_count(spark, 1000) == 1
    assert bucket_count(spark, 40 * BUCKET_BYTES // ROW_BYTES + 1) == 41


def test_cache_loads_again_after_a_source_file_changed(spark, tmp_path):
    for name in ("customer", "nation", "region", "orders", "lineitem"):
        shutil.copyfile(f"{SF_SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    cache = TableCache()
    assert kpis.overall_churn(cache.get(spark, str(tmp_path))).first().total_customers == 150
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_custkey % 3 = 0")
    expected = orders.agg(F.countDistinct("o_custkey")).first()[0]
    assert 0 < expected < 150
    orders.toPandas().to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    assert kpis.overall_churn(cache.get(spark, str(tmp_path))).first().total_customers == expected
    databases = [t.database for t in cache._cache.values()]
    assert len(databases) == 2
    cache.drop()
    assert not any(spark.catalog.databaseExists(d) for d in databases)


def test_no_local_folder_off_a_local_master():
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf={})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(session)


@pytest.mark.parametrize("name", sorted(CONSTRAINTS))
def test_each_constraint_can_fail(spark, cache, name):
    rows = CONSTRAINTS[name](cache.get_faulty(spark, SF_SMALL)).collect()
    assert all(r.violations > 0 for r in rows)


def test_repeated_surrogate_keys_are_counted(spark, small_tables):
    from dataclasses import replace
    doubled = small_tables.usage_metrics.withColumn("metric_id", F.pmod("customer_id", F.lit(10)))
    rows = CONSTRAINTS["check_primary_key"](replace(small_tables, usage_metrics=doubled)).collect()
    assert {r.constraint_name: r.violations for r in rows}["usage_metrics.metric_id PRIMARY KEY"] == 10
