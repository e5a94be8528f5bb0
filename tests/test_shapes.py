"""Shape checks of the derived tables and the dirty fixture (values agreed by two engines)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from churnlens.operators import cleaning, segments
from churnlens.plans.tables import ChurnTables
from churnlens.sources.dirty import make_dirty
from tests.conftest import SF_ORACLE, SF_SMALL

EXPECTED = {
    SF_SMALL: dict(customers=150, churned=49, tenure=[2, 6, 7, 21, 114], tenure_churned=[0, 0, 3, 6, 40],
                   login=[2, 22, 62, 64], login_churned=[2, 13, 22, 12], billing=[88, 46, 16],
                   risk=[48, 51, 2, 0], months=20, days=46, logins_zero=0, logins_edges=20,
                   dirty=158, null_regions=5, null_prices=8, lower=15, slash=13, dedup=152, invalid=6),
    SF_ORACLE: dict(customers=1500, churned=487, tenure=[53, 53, 121, 240, 1033],
                    tenure_churned=[0, 0, 24, 89, 374], login=[14, 206, 698, 582],
                    login_churned=[6, 104, 251, 126], billing=[777, 520, 203], risk=[447, 514, 49, 3],
                    months=38, days=318, logins_zero=1, logins_edges=202,
                    dirty=1575, null_regions=49, null_prices=75, lower=150, slash=125, dedup=1527, invalid=32),
}


@pytest.fixture(scope="module", params=[SF_SMALL, SF_ORACLE])
def case(request, spark):
    return ChurnTables.derive(spark, request.param), EXPECTED[request.param]


def test_customer_counts(case):
    t, e = case
    row = t.customers.agg(F.count("*").alias("n"), F.sum(F.col("is_churned").cast("int")).alias("c")).first()
    assert (row.n, row.c) == (e["customers"], e["churned"])


def test_tenure_buckets(case):
    t, e = case
    rows = {r.tenure_bucket: r for r in segments.churn_by_tenure_bucket(t).collect()}
    order = ["0-3 months", "3-6 months", "6-12 months", "1-2 years", "2+ years"]
    assert [rows[k].total_customers if k in rows else 0 for k in order] == e["tenure"]
    assert [rows[k].churned if k in rows else 0 for k in order] == e["tenure_churned"]


def test_login_and_billing_tiers(case):
    t, e = case
    login = {r.engagement_tier: r for r in segments.churn_by_login_tier(t).collect()}
    order = ["Very Low (0-2/mo)", "Low (3-7/mo)", "Medium (8-14/mo)", "High (15+/mo)"]
    assert [login[k].total_customers for k in order] == e["login"]
    assert [login[k].churned for k in order] == e["login_churned"]
    billing = {r.billing_issue_tier: r.total_customers for r in segments.churn_by_billing_tier(t).collect()}
    assert [billing[k] for k in ["No Issues", "1 Issue", "2+ Issues"]] == e["billing"]


def test_risk_scores_among_active(case):
    from churnlens.functions.tiers import risk_score
    t, e = case
    df = t.customers.filter(~F.col("is_churned")).join(t.usage_metrics, "customer_id")
    counts = {r.s: r["count"] for r in df.groupBy(risk_score().alias("s")).count().collect()}
    assert [counts.get(i, 0) for i in range(4)] == e["risk"]


def test_calendar_and_edges(case):
    t, e = case
    churned = t.customers.filter("is_churned")
    assert churned.select(F.trunc("cancellation_date", "MM")).distinct().count() == e["months"]
    assert churned.select("cancellation_date").distinct().count() == e["days"]
    w = t.wide
    assert w.filter(F.col("avg_monthly_logins") == 0).count() == e["logins_zero"]
    assert w.filter(F.col("avg_monthly_logins").isin(3, 8, 15)).count() == e["logins_edges"]
    assert t.customers.filter(F.col("cancellation_date") < F.col("join_date")).count() == 0


def test_dirty_fixture(case):
    t, e = case
    d = make_dirty(t.wide)
    row = d.agg(
        F.count("*").alias("n"),
        F.sum(F.col("region").isNull().cast("int")).alias("r"),
        F.sum(F.col("plan_price").isNull().cast("int")).alias("p"),
        F.sum((F.col("plan_name") == F.lower("plan_name")).cast("int")).alias("l"),
        F.sum(F.col("join_date").contains("/").cast("int")).alias("s"),
    ).first()
    assert (row.n, row.r, row.p, row.l, row.s) == (
        e["dirty"], e["null_regions"], e["null_prices"], e["lower"], e["slash"])
    assert cleaning.exact_dedup(d).count() == e["dedup"]
    assert d.select("customer_id").distinct().count() == e["customers"]
    parsed = cleaning.parse_cancellation_date(cleaning.parse_join_date(d))
    bad = parsed.filter(cleaning.invalid_cancellation()).select("customer_id").distinct().count()
    assert bad == e["invalid"]
