"""Work that shares one scan: cleaning with its report, correlations, bins and trend; checked writes; appended keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from churnlens.operators import cleaning, statistics
from churnlens.operators.appended import check_appended
from churnlens.operators.audit import intake
from churnlens.operators.constraints import check_foreign_key, check_primary_key
from churnlens.plans.catalog import awkward_texts, redelivered
from churnlens.plans.tables import ChurnTables
from churnlens.sources.dirty import make_dirty
from churnlens.sources.files import fingerprint, write_csv_checked
from tests.conftest import SF_SMALL


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("dedup", ["exact", "key"])
def test_cleaning_and_report_together(spark, small_tables, tmp_path, dedup):
    dirty = make_dirty(small_tables.wide)
    cleaned, figures = cleaning.observed_clean(dirty, dedup=dedup)
    cleaned.write.parquet(str(tmp_path / "out"))
    back, expected = spark.read.parquet(str(tmp_path / "out")), cleaning.clean(dirty, dedup=dedup)
    assert back.exceptAll(expected).count() == expected.exceptAll(back).count() == 0
    assert cleaning.reported(spark, figures).collect() == cleaning.cleaning_report(dirty).collect()


def test_cleaning_reads_and_dedups_once(small_tables):
    cleaned, _ = cleaning.observed_clean(make_dirty(small_tables.wide.filter("customer_id % 20 <> 0")))
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    # the fixture's second copies are a branch of their own; no further scan, one dedup exchange
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_report_of_no_rows(spark, small_tables, tmp_path):
    cleaned, figures = cleaning.observed_clean(make_dirty(small_tables.wide).filter("false"))
    cleaned.write.parquet(str(tmp_path / "out"))
    assert [r.value for r in cleaning.reported(spark, figures).collect()] == [0] * 6
    with pytest.raises(ValueError, match="exact"):
        cleaning.observed_clean(make_dirty(small_tables.wide), dedup="none")


def test_correlations_are_pairwise_complete(make_tables):
    rows = [{"customer_id": i, "is_churned": i % 3 == 0, "tenure_months": None if i % 5 == 0 else i, "support_tickets": i * i,
             "billing_issues_count": 4} for i in range(1, 40)]
    tables = make_tables(rows)
    found = {(r.feature_a, r.feature_b): r.r for r in statistics.correlation_matrix(tables).collect()}
    x = [(r["tenure_months"], r["support_tickets"]) for r in rows if r["tenure_months"] is not None]
    n, mx, my = len(x), sum(a for a, _ in x) / len(x), sum(b for _, b in x) / len(x)
    cov = sum((a - mx) * (b - my) for a, b in x) / n
    var = [sum((v[k] - m) ** 2 for v in x) / n for k, m in ((0, mx), (1, my))]
    assert found["tenure_months", "support_tickets"] == pytest.approx(cov / (var[0] * var[1]) ** 0.5, abs=1e-6)
    assert found["support_tickets", "tenure_months"] == found["tenure_months", "support_tickets"]
    assert found["billing_issues_count", "billing_issues_count"] is None  # constant
    assert found["plan_price", "plan_price"] is None  # no value at all
    assert found["support_tickets", "support_tickets"] == 1.0 and len(found) == 49


def test_one_scan_for_the_matrix_the_bins_and_the_trend(small_tables):
    for op in (statistics.correlation_matrix, statistics.churn_correlations, statistics.top3_churn_factors):
        assert executed(op(small_tables)).count("FileScan") == 1
    for op in (statistics.engagement_bins, statistics.engagement_trend):
        df = op(small_tables)
        df.collect()
        # bins and range read the same table of frequencies
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_csv_keeps_every_cell(spark, small_tables, tmp_path):
    texts = awkward_texts(small_tables)
    back = write_csv_checked(texts, str(tmp_path / "csv"))
    assert back.exceptAll(texts).count() == texts.exceptAll(back).count() == 0
    assert back.filter("text = ''").count() > 0 and back.filter("text IS NULL").count() > 0


def test_a_changed_file_is_noticed(spark, small_tables, tmp_path, monkeypatch):
    from churnlens.sources import files

    def losing(df, path, mode="overwrite"):
        df.withColumn("text", F.trim("text")).write.mode(mode).options(**files.CSV_FORM).csv(path)
    monkeypatch.setattr(files, "write_csv", losing)
    with pytest.raises(ValueError, match="does not hold what was written"):
        files.write_csv_checked(awkward_texts(small_tables), str(tmp_path / "csv"))


def test_fingerprints(spark):
    def of(rows):
        return fingerprint(spark.createDataFrame(rows, "a string, b string"))
    assert of([("x", None), ("y", "z")]) == of([("y", "z"), ("x", None)])
    for other in ([("x", ""), ("y", "z")], [(None, "x"), ("y", "z")], [("x", None)], [("x", None), ("x", None), ("y", "z")]):
        assert of(other) != of([("x", None), ("y", "z")])
    assert of([]) == (0, 0, 0)


def test_appended_keys_without_a_shuffle_of_the_loaded(spark, cache):
    loaded = cache.get(spark, SF_SMALL)
    found = check_appended(loaded, redelivered(loaded))
    assert all(r.violations > 0 for r in found.collect() if not r.constraint_name.startswith("usage"))
    plan = check_appended(loaded, redelivered(loaded))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "Bucketed: true" in line and "tenure_months" not in line]
    assert len(scans) == 1
    # nothing between the loaded scan and the join but the sort of its bucket
    depth = plan.splitlines().index(scans[0])
    above = []
    indent = len(scans[0]) - len(scans[0].lstrip(" :+-"))
    for line in reversed(plan.splitlines()[:depth]):
        here = len(line) - len(line.lstrip(" :+-"))
        if here < indent:
            above.append(line)
            indent = here
        if "SortMergeJoin" in line:
            break
    assert above and not any("Exchange" in line for line in above)


def test_appended_check_equals_the_full_one(spark, cache, make_tables):
    loaded = cache.get(spark, SF_SMALL)
    new = intake(loaded.records.filter("customer_id < 10").unionByName(
        loaded.records.filter("customer_id > 140").withColumn("customer_id", F.lit(777_777))).unionByName(
        loaded.records.filter("customer_id = 20").withColumn("customer_id", F.lit(None).cast("long"))))
    orphans = new.filter("record_id < 5").withColumn("customers", F.lit(None).cast(new.schema["customers"].dataType)) \
        .withColumn("usage_metrics", F.col("usage_metrics").withField("customer_id", F.col("record_id") - 5_000))
    new = new.unionByName(orphans)
    old = intake(loaded.records)
    both = old.unionByName(new)
    parts = {r: both.filter(F.col(r).isNotNull()).select(f"{r}.*") for r in ("customers", "subscriptions", "usage_metrics")}
    whole = ChurnTables(wide=loaded.wide, subscription_plans=loaded.subscription_plans, **parts)
    full = {r.constraint_name: r.violations for r in check_primary_key(whole).unionByName(check_foreign_key(whole)).collect()}
    found = {r.constraint_name: r.violations for r in check_appended(loaded, new).collect()}
    assert found == {k: full[k] for k in found} and all(v > 0 for k, v in found.items() if not k.startswith("subs"))
