"""Invariants that must hold on any input (checked on the sf0.001 tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.operators import cleaning, kpis, risk, segments, statistics, timeseries
from churnlens.sources.dirty import make_dirty


def test_churned_plus_active_is_total(small_tables):
    r = kpis.overall_churn(small_tables).first()
    assert r.total_churned + r.total_active == r.total_customers
    assert abs(r.churn_rate_pct + r.retention_rate_pct - 100) < 0.011


def test_segment_counts_sum_to_total(small_tables):
    total = small_tables.customers.count()
    for op in (segments.churn_by_region_ranked, segments.churn_by_age_group, segments.churn_by_tenure_bucket,
               segments.churn_by_login_tier, segments.churn_by_billing_tier, segments.churn_by_region_plan):
        assert op(small_tables).agg(F.sum("total_customers")).first()[0] == total, op.__name__


def test_cumulative_ends_at_total_churned(small_tables):
    rows = timeseries.monthly_churn_cumulative(small_tables).collect()
    churned = small_tables.customers.filter("is_churned and cancellation_date is not null").count()
    assert rows[-1].cumulative_churned == churned
    assert all(a.cumulative_churned < b.cumulative_churned for a, b in zip(rows, rows[1:]))


def test_net_growth_balances(small_tables):
    s = timeseries.monthly_net_growth(small_tables).agg(
        F.sum("new_customers"), F.sum("churned_customers"), F.sum("net_growth")).first()
    assert s[2] == s[0] - s[1]
    assert s[0] == small_tables.customers.count()


def test_reason_shares_sum_to_100(small_tables):
    total = risk.cancellation_reasons(small_tables).agg(F.sum("percentage_of_churned")).first()[0]
    assert abs(total - 100) < 0.05


def test_matrix_symmetric_with_unit_diagonal(small_tables):
    cells = {(r.feature_a, r.feature_b): r.r for r in statistics.correlation_matrix(small_tables).collect()}
    for (a, b), v in cells.items():
        assert cells[(b, a)] == v
        if a == b:
            assert v == 1.0


def test_second_cleaning_only_removes_new_duplicates(spark, small_tables):
    """Dedup runs before normalisation, so rows that became equal only after it
    survive one pass; a second pass is the distinct set of the first."""
    once = cleaning.clean(make_dirty(small_tables.wide))
    twice = cleaning.clean(once.select(*[F.col(c).cast("string") if c in ("join_date", "cancellation_date")
                                         else F.col(c) for c in once.columns]))
    distinct = once.distinct()
    assert distinct.exceptAll(twice).count() == 0 and twice.exceptAll(distinct).count() == 0
    key_once = cleaning.clean(make_dirty(small_tables.wide), dedup="key")
    assert key_once.count() == key_once.select("customer_id").distinct().count()


def test_risk_score_counts_flags(small_tables):
    df = risk.high_risk_customers(small_tables, limit=10_000)
    bad = df.filter(
        F.col("risk_score") != (
            (F.col("tenure_months") < 6).cast("int") + (F.col("avg_monthly_logins") < 5).cast("int")
            + (F.col("billing_issues_count") > 0).cast("int"))
    )
    assert bad.count() == 0


def test_findings_sections(small_tables):
    from churnlens.operators.report import findings
    rows = findings(small_tables).collect()
    sections = {r.section for r in rows}
    assert sections == {"key_metrics", "top_drivers", "churn_by_plan", "churn_by_region"}
    assert sum(1 for r in rows if r.section == "top_drivers") == 3
