"""Sources and sinks: CSV with explicit schema, required columns, lookup and findings sinks, table listing."""

from __future__ import annotations

import glob
import os
import tempfile

import pytest

from churnlens.operators.report import findings
from churnlens.sources.files import read_customers_csv, require_columns, write_csv, write_findings, write_plans_csv
from churnlens.sources.warehouse import list_tables, plans_frame


def test_csv_round_trip(spark, small_tables):
    out = os.path.join(tempfile.mkdtemp(prefix="churnlens-io-"), "clean")
    wide = small_tables.wide
    write_csv(wide.withColumn("is_churned", wide["is_churned"].cast("int")), out)
    back = read_customers_csv(spark, out)
    assert back.schema == wide.schema
    assert back.exceptAll(wide).count() == 0 and wide.exceptAll(back).count() == 0


def _csv(lines):
    path = os.path.join(tempfile.mkdtemp(prefix="churnlens-io-"), "in.csv")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def _record(**changes):
    row = {"customer_id": "7", "age": "30", "age_group": "25-34", "region": "West", "plan_name": "Basic",
           "plan_price": "9.99", "payment_method": "Card", "join_date": "2023-01-05", "tenure_months": "3",
           "avg_monthly_logins": "4.0", "avg_session_minutes": "5.0", "support_tickets": "1",
           "billing_issues_count": "0", "is_churned": "0", "cancellation_date": "", "cancellation_reason": "",
           "customer_lifetime_days": "90"}
    return {**row, **changes}


def test_csv_columns_are_found_by_name(spark):
    row = {"note": "x", **dict(reversed(_record().items()))}
    got = read_customers_csv(spark, _csv([",".join(row), ",".join(row.values())])).first()
    assert (got.customer_id, got.region, got.plan_name, str(got.plan_price)) == (7, "West", "Basic", "9.99")
    assert got.cancellation_date is None and got.is_churned is False


def test_csv_without_a_column_is_refused(spark):
    row = _record()
    del row["region"]
    with pytest.raises(ValueError, match=r"\['region'\]"):
        read_customers_csv(spark, _csv([",".join(row), ",".join(row.values())]))


def test_csv_files_with_other_headers_are_refused(spark):
    row, swapped = _record(), dict(reversed(_record().items()))
    path = _csv([",".join(row), ",".join(row.values())])
    with open(os.path.join(os.path.dirname(path), "other.csv"), "w") as f:
        f.write(",".join(swapped) + "\n" + ",".join(swapped.values()) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_customers_csv(spark, os.path.dirname(path)).collect()


def test_csv_bad_cells_fail_or_become_null(spark):
    row = _record(plan_price="cheap", join_date="soon")
    path = _csv([",".join(row), ",".join(row.values())])
    with pytest.raises(ValueError, match="'plan_price': 1, 'join_date': 1"):
        read_customers_csv(spark, path)
    with pytest.raises(ValueError, match="'plan_price': 1}"):
        read_customers_csv(spark, path, parse_dates=False)
    got = read_customers_csv(spark, path, bad="null").first()
    assert got.plan_price is None and got.join_date is None and got.customer_id == 7


def test_required_columns_error_lists_missing(small_tables):
    with pytest.raises(ValueError, match=r"lacks the columns \['region', 'age_group'\]"):
        require_columns(small_tables.wide.drop("region", "age_group"))


def test_plans_and_findings_sinks(spark, small_tables):
    root = tempfile.mkdtemp(prefix="churnlens-io-")
    write_plans_csv(plans_frame(spark), os.path.join(root, "plans"))
    back = spark.read.option("header", True).csv(os.path.join(root, "plans")).collect()
    assert sorted(r.plan_name for r in back) == ["Basic", "Premium", "Standard"]
    write_findings(findings(small_tables), os.path.join(root, "report"))
    files = glob.glob(os.path.join(root, "report", "part-*"))
    assert len(files) == 1
    lines = open(files[0]).read().splitlines()
    assert lines[0].startswith("generated\t") and lines[0].endswith("customers\t150")
    assert lines[1].startswith("key_metrics\t1\ttotal_customers")
    assert len(lines) == findings(small_tables).count() + 1


def test_list_tables(spark, small_tables):
    names = [r.table_name for r in list_tables(spark, small_tables.database).collect()]
    assert names == ["customers", "records", "subscription_plans", "subscriptions", "usage_metrics"]


def test_declared_defaults_fill_omitted_columns(small_tables):
    from churnlens.sources.warehouse import load_customers, load_usage_metrics
    usage = load_usage_metrics(small_tables.wide.drop("support_tickets", "billing_issues_count"))
    assert usage.filter("support_tickets = 0 and billing_issues_count = 0").count() == usage.count()
    customers = load_customers(small_tables.wide.drop("is_churned"))
    assert customers.filter("is_churned = false").count() == customers.count()
