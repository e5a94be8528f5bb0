"""The command-line jobs: clean raw CSV, analyse cleaned CSV, report from source tables."""

from __future__ import annotations

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from churnlens.cli import ANALYSIS_QUERIES, main
from churnlens.operators.cleaning import clean
from churnlens.plans.loads import Warehouse
from churnlens.sources.dirty import make_dirty
from churnlens.sources.files import read_customers_csv
from tests.conftest import SF_SMALL


def test_clean_then_analyze(spark, small_tables):
    root = tempfile.mkdtemp(prefix="churnlens-cli-")
    raw_dir = os.path.join(root, "raw")
    dirty = make_dirty(small_tables.wide)
    dirty.withColumn("is_churned", F.col("is_churned").cast("int")).write.option("header", True).csv(raw_dir)

    main(["clean", "--input", raw_dir, "--output", os.path.join(root, "clean")])
    cleaned = read_customers_csv(spark, os.path.join(root, "clean", "customers_clean"))
    expected = clean(make_dirty(small_tables.wide))
    assert cleaned.exceptAll(expected).count() == 0 and expected.exceptAll(cleaned).count() == 0
    report = {r.metric: int(r.value) for r in
              spark.read.option("header", True).csv(os.path.join(root, "clean", "cleaning_report")).collect()}
    assert report["rows_in"] == 158 and report["rows_out"] == 152

    main(["analyze", "--input", os.path.join(root, "clean", "customers_clean"),
          "--output", os.path.join(root, "analysis")])
    for name in ANALYSIS_QUERIES:
        assert spark.read.parquet(os.path.join(root, "analysis", name)).columns, name
    assert glob.glob(os.path.join(root, "analysis", "churn_summary_report", "part-*"))


def test_report_from_tables(spark):
    out = tempfile.mkdtemp(prefix="churnlens-cli-")
    main(["report", "--sf-dir", SF_SMALL, "--output", out, "--only", "overall_churn", "high_risk_customers"])
    row = spark.read.parquet(os.path.join(out, "overall_churn")).first()
    assert (row.total_customers, row.total_churned) == (150, 49)
    assert spark.read.parquet(os.path.join(out, "high_risk_customers")).count() == 100


def test_load_exports_relational_tables(spark):
    out = tempfile.mkdtemp(prefix="churnlens-cli-")
    main(["load", "--sf-dir", SF_SMALL, "--output", out])
    tables = os.path.join(Warehouse(spark, out).current_folder(), "tables")
    subs = spark.read.parquet(os.path.join(tables, "subscriptions"))
    assert subs.count() == 150
    assert sorted(r[0] for r in subs.select("subscription_id").collect()) == list(range(1, 151))
    usage = spark.read.parquet(os.path.join(tables, "usage_metrics"))
    assert {"metric_id", "recorded_at"} <= set(usage.columns)
    assert spark.read.parquet(os.path.join(tables, "subscription_plans")).count() == 3
    assert "created_at" in spark.read.parquet(os.path.join(tables, "customers")).columns


def test_load_and_report_from_cleaned_records(spark, small_tables):
    root = tempfile.mkdtemp(prefix="churnlens-cli-")
    raw, clean_dir = os.path.join(root, "raw"), os.path.join(root, "clean")
    make_dirty(small_tables.wide).withColumn("is_churned", F.col("is_churned").cast("int")) \
        .write.option("header", True).csv(raw)
    main(["clean", "--input", raw, "--output", clean_dir])
    records = os.path.join(clean_dir, "customers_clean")
    before = {d.name for d in spark.catalog.listDatabases()}
    with pytest.raises(ValueError, match="2 ids are repeated, 0 rows have none"):
        main(["load", "--input", records, "--output", os.path.join(root, "none")])

    main(["clean", "--input", raw, "--output", clean_dir, "--dedup", "key"])
    main(["load", "--input", records, "--output", os.path.join(root, "tables")])
    folder = Warehouse(spark, os.path.join(root, "tables")).current_folder()
    assert spark.read.parquet(os.path.join(folder, "tables", "customers")).count() == 150
    main(["report", "--input", records, "--output", os.path.join(root, "report"), "--only", "mrr_by_plan"])
    report = spark.read.parquet(os.path.join(root, "report", "mrr_by_plan"))
    active = read_customers_csv(spark, records).filter("not is_churned")
    assert report.agg(F.sum("active_subscribers")).first()[0] == active.count()
    assert {d.name for d in spark.catalog.listDatabases()} == before


def test_module_entry_point_lists_commands():
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-m", "churnlens", "--help"], cwd=root,
                         capture_output=True, text=True, timeout=120)
    assert out.returncode == 0
    for command in ("clean", "analyze", "load", "report"):
        assert command in out.stdout
