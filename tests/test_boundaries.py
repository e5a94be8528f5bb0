"""Hand-written boundary rows: bin edges under both closure rules, ties, NULLs,
constant columns, unparseable dates, repairs, gaps, empty input."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from churnlens.functions import tiers
from churnlens.functions.dates import parse_mixed_date
from churnlens.operators import cleaning, constraints, kpis, risk, segments, statistics, timeseries
from churnlens.plans.catalog import ANALYTICS
from churnlens.plans.tables import ChurnTables
from churnlens.schemas import RAW_SCHEMA, WIDE_SCHEMA

D = Decimal


def base_row(i: int, **kw) -> dict:
    row = dict(
        customer_id=i, age=30, age_group="25-34", region="West", plan_name="Basic",
        plan_price=D("9.99"), payment_method="PayPal", join_date=dt.date(2022, 1, 1),
        tenure_months=20, avg_monthly_logins=D("10.0"), avg_session_minutes=D("30.0"),
        support_tickets=0, billing_issues_count=0, is_churned=False, cancellation_date=None,
        cancellation_reason=None, customer_lifetime_days=600,
    )
    row.update(kw)
    return row


def one_col(spark, values, dtype):
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", dtype)]))


def test_login_tiers_both_closure_rules(spark):
    vals = [D("0"), D("0.1"), D("3"), D("3.1"), D("8"), D("15"), D("100"), D("101"), None]
    df = one_col(spark, vals, T.DecimalType(18, 1))
    labels = tiers.LOGIN_TIER_LABELS
    right = [r.t for r in df.select(tiers.right_closed_bin("x", tiers.LOGIN_TIER_EDGES, labels).alias("t")).collect()]
    idx = [None if t is None else labels.index(t) + 1 for t in right]
    assert idx == [None, 1, 1, 2, 2, 3, 4, None, None]
    left_labels = [lab for _, lab in tiers.LOGIN_TIERS] + [tiers.LOGIN_TIER_ELSE]
    left = [left_labels.index(r.t) + 1 for r in df.select(tiers.login_tier("x").alias("t")).collect()]
    assert left == [1, 1, 2, 2, 3, 4, 4, 4, 4]


def test_tenure_tiers_both_closure_rules(spark):
    vals = [0, 2, 3, 5, 6, 11, 12, 23, 24, None]
    df = one_col(spark, vals, T.IntegerType())
    labels = tiers.TENURE_TIER_LABELS
    right = [r.t for r in df.select(tiers.right_closed_bin("x", tiers.TENURE_TIER_EDGES, labels).alias("t")).collect()]
    assert [None if t is None else labels.index(t) + 1 for t in right] == [None, 1, 1, 2, 2, 3, 3, 4, 4, None]
    order = tiers.TENURE_BUCKET_ORDER
    left = [order.index(r.t) + 1 for r in df.select(tiers.tenure_bucket("x").alias("t")).collect()]
    assert left == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def _pandas_bins(values: list[float], n: int = 10):
    s = pd.Series(values, dtype="float64")
    codes = pd.cut(s, bins=n, labels=False)
    mn, mx = s.min(), s.max()
    if mn == mx:
        mn = mn - 0.001 * abs(mn) if mn != 0 else mn - 0.001
        mx = mx + 0.001 * abs(mx) if mx != 0 else mx + 0.001
        edges = np.linspace(mn, mx, n + 1)
    else:
        edges = np.linspace(mn, mx, n + 1)
        edges[0] -= (mx - mn) * 0.001
    return codes, edges


@pytest.mark.parametrize("values", [[0, 1, 5, 10, 33.3], [5, 5, 5], [0, 0], [2, 3, 8, 15, 15, 40.5, 0.5]])
def test_equal_width_bins_match_pandas_cut(make_tables, values):
    rows = [base_row(i, avg_monthly_logins=D(str(v)), is_churned=(i % 2 == 0)) for i, v in enumerate(values)]
    rows.append(base_row(999, avg_monthly_logins=None))
    t = make_tables(rows)
    got = {r.bin: r for r in statistics.engagement_bins(t).collect()}
    codes, edges = _pandas_bins([float(v) for v in values])
    expected_counts = codes.value_counts().to_dict()
    assert {b: r.n for b, r in got.items()} == {int(k) + 1: v for k, v in expected_counts.items()}
    for b, r in got.items():
        assert r.midpoint == pytest.approx((edges[b - 1] + edges[b]) / 2, abs=1e-6)


def test_engagement_trend_matches_polyfit(make_tables):
    vals = [0.5, 1, 2, 3, 5, 8, 9, 13, 21, 34, 34, 20]
    rows = [base_row(i, avg_monthly_logins=D(str(v)), is_churned=v < 9 or i % 3 == 0) for i, v in enumerate(vals)]
    t = make_tables(rows)
    bins = statistics.engagement_bins(t).toPandas()
    slope, intercept = np.polyfit(bins["midpoint"], bins["churn_pct"], 1)
    row = statistics.engagement_trend(t).first()
    assert row.slope == pytest.approx(slope, abs=1e-4)
    assert row.intercept == pytest.approx(intercept, abs=1e-3)


def test_billing_tiers_and_fixed_domain(spark, make_tables):
    df = one_col(spark, [0, 1, 2, 7, None], T.LongType())
    got = [r.t for r in df.select(tiers.billing_tier("x").alias("t")).collect()]
    assert got == ["No Issues", "1 Issue", "2+ Issues", "2+ Issues", "2+ Issues"]
    t = make_tables([base_row(1, billing_issues_count=0, is_churned=True), base_row(2, billing_issues_count=3)])
    out = [(r.tier, r.churn_pct) for r in segments.billing_tier_fixed_domain(t).collect()]
    assert out == [("No Issues", 100.0), ("1 Issue", None), ("2+ Issues", 0.0)]


def test_rank_ties_and_null_region(make_tables):
    rows = [
        base_row(1, region="A", is_churned=True), base_row(2, region="A"),
        base_row(3, region="B", is_churned=True), base_row(4, region="B"),
        base_row(5, region="C"),
        base_row(6, region=None, is_churned=True),
    ]
    out = {r.region: r.churn_rank for r in segments.churn_by_region_ranked(make_tables(rows)).collect()}
    assert out == {None: 1, "A": 2, "B": 2, "C": 4}


def test_top_k_ties_are_cut_deterministically(make_tables):
    rows = [base_row(i, tenure_months=3, avg_monthly_logins=D("1.0"), billing_issues_count=1) for i in range(150, 0, -1)]
    out = risk.high_risk_customers(make_tables(rows)).collect()
    assert len(out) == 100
    assert [r.customer_id for r in out] == list(range(1, 101))
    assert all(r.risk_score == 3 for r in out)


def _pandas_corr(rows, feature):
    pdf = pd.DataFrame(rows)[[feature, "is_churned"]].astype("float64")
    return pdf.corr().loc[feature, "is_churned"]


def test_correlation_constant_null_pairs_and_single_row(make_tables):
    rows = [base_row(i, support_tickets=2, tenure_months=i * 3, is_churned=i % 3 == 0,
                     avg_session_minutes=None if i % 4 == 0 else D(f"{i * 1.5:.1f}"))
            for i in range(1, 13)]
    out = {r.feature: r for r in statistics.churn_correlations(make_tables(rows)).collect()}
    assert out["support_tickets"].r is None  # constant column: NULL, no error
    assert out["support_tickets"].direction == "NEGATIVE"
    pdf_rows = [{k: (float(v) if isinstance(v, D) else v) for k, v in r.items()} for r in rows]
    for f in ("tenure_months", "avg_session_minutes"):
        assert out[f].r == pytest.approx(_pandas_corr(pdf_rows, f), abs=1e-6)
    single = statistics.churn_correlations(make_tables([base_row(1)])).collect()
    assert all(r.r is None for r in single)
    matrix = statistics.correlation_matrix(make_tables(rows)).collect()
    diag = {r.feature_a: r.r for r in matrix if r.feature_a == r.feature_b}
    assert diag["support_tickets"] is None and diag["tenure_months"] == 1.0


def test_mixed_date_parsing(spark):
    df = one_col(spark, ["2021-03-04", "03/04/2021", "2021-03-04 00:00:00", "3/4/2021", "x", "", None],
                 T.StringType())
    got = [r.d for r in df.select(parse_mixed_date("x").alias("d")).collect()]
    d = dt.date(2021, 3, 4)
    assert got == [d, d, d, d, None, None, None]


def test_further_date_forms(spark):
    texts = ["2023/01/05", "05-Jan-2023", "January 5, 2023", "JAN 5, 2023", "may 5, 2023", "20230105", "1/5/23",
             "2023-1-5", "2023/13/05", "32-Jan-2023", "Janu 5, 2023"]
    got = [r.d for r in one_col(spark, texts, T.StringType()).select(parse_mixed_date("x").alias("d")).collect()]
    d = dt.date(2023, 1, 5)
    assert got == [d, d, d, d, dt.date(2023, 5, 5), d, d, d, None, None, None]


def test_strict_check_survives_column_pruning(spark):
    raw = _raw(spark, [base_row(1, join_date="not a date", region="West")])
    with pytest.raises(Exception, match="unparseable join_date"):
        cleaning.clean(raw).groupBy("region").count().collect()


def test_key_dedup_keeps_rows_without_an_id(spark):
    rows = [base_row(None, region="West"), base_row(None, region="East"), base_row(1), base_row(1)]
    assert cleaning.key_dedup(_raw(spark, rows)).count() == 3


def test_strict_join_date_fails_on_garbage(spark):
    raw = _raw(spark, [base_row(1, join_date="not a date")])
    with pytest.raises(Exception, match="unparseable join_date"):
        cleaning.parse_join_date(raw, strict=True).collect()
    assert cleaning.parse_join_date(raw, strict=False).first().join_date is None


def _raw(spark, rows):
    def conv(v):
        return v.isoformat() if isinstance(v, dt.date) else v
    data = [tuple(conv(r.get(f.name)) for f in RAW_SCHEMA.fields) for r in rows]
    return spark.createDataFrame(data, RAW_SCHEMA)


def test_date_repair(spark):
    j = dt.date(2022, 5, 10)
    rows = [
        base_row(1, join_date=j, is_churned=True, cancellation_date=j - dt.timedelta(days=1),
                 cancellation_reason="r", customer_lifetime_days=-1),
        base_row(2, join_date=j, is_churned=True, cancellation_date=j, cancellation_reason="r"),
        base_row(3, join_date=j, is_churned=False, cancellation_date=None),
    ]
    out = {r.customer_id: r for r in cleaning.clean(_raw(spark, rows)).collect()}
    assert (out[1].is_churned, out[1].cancellation_date, out[1].cancellation_reason) == (False, None, None)
    assert out[1].customer_lifetime_days == -1  # not recomputed
    assert (out[2].is_churned, out[2].cancellation_date) == (True, j)
    assert (out[3].is_churned, out[3].cancellation_date) == (False, None)


def test_price_fill(spark):
    rows = [
        base_row(1, plan_name="premium", plan_price=None),
        base_row(2, plan_name="Gold", plan_price=None),
        base_row(3, plan_name="Basic", plan_price=D("1.00")),
    ]
    out = {r.customer_id: r for r in cleaning.clean(_raw(spark, rows)).collect()}
    assert (out[1].plan_name, out[1].plan_price) == ("Premium", D("22.99"))
    assert out[2].plan_price is None
    assert out[3].plan_price == D("1.00")
    report = {r.metric: r.value for r in cleaning.cleaning_report(_raw(spark, rows)).collect()}
    assert report["prices_filled"] == 2  # unknown plan counted although it stays NULL


def test_exact_dedup_treats_nulls_as_equal_and_key_dedup_prefers_known_region(spark):
    a = base_row(1, region=None)
    rows = [a, dict(a), base_row(1, region="West"), base_row(2)]
    cleaned = cleaning.clean(_raw(spark, rows))
    assert cleaned.count() == 3
    keyed = {r.customer_id: r for r in cleaning.clean(_raw(spark, rows), dedup="key").collect()}
    assert len(keyed) == 2 and keyed[1].region == "West"


def test_rolling_rows_vs_calendar_days(make_tables):
    start = dt.date(2023, 1, 1)
    rows = [base_row(i, is_churned=True, cancellation_date=start + dt.timedelta(days=2 * i), join_date=start)
            for i in range(40)]
    t = make_tables(rows)
    by_rows = timeseries.rolling_30row_churn(t).collect()
    by_days = timeseries.rolling_30day_calendar(t).collect()
    assert [r.rolling_30d_churn for r in by_rows][-1] == 30
    assert [r.rolling_30day_churn for r in by_days][-1] == 15


def test_full_outer_months(make_tables):
    rows = [
        base_row(1, join_date=dt.date(2023, 1, 15)),
        base_row(2, join_date=dt.date(2023, 1, 20), is_churned=True, cancellation_date=dt.date(2023, 3, 2)),
    ]
    out = [(r.month, r.new_customers, r.churned_customers, r.net_growth)
           for r in timeseries.monthly_net_growth(make_tables(rows)).collect()]
    assert out == [(dt.date(2023, 1, 1), 2, 0, 2), (dt.date(2023, 3, 1), 0, 1, -1)]


def test_constraints(spark, make_tables):
    rows = [
        base_row(1, age=17), base_row(1, age=18), base_row(2, age=100), base_row(3, age=101),
        base_row(4, age=None),
        base_row(5, is_churned=True, cancellation_date=dt.date(2021, 1, 1)),
    ]
    t = make_tables(rows)
    pk = {r.constraint_name: r.violations for r in constraints.check_primary_key(t).collect()}
    assert pk["customers.customer_id PRIMARY KEY"] == 1
    rng = {r.constraint_name: r.violations for r in constraints.check_range(t).collect()}
    assert rng["customers.age BETWEEN 18 AND 100"] == 2  # 17 and 101; NULL passes
    order = {r.constraint_name: r.violations for r in constraints.check_date_order(t).collect()}
    assert order["customers.chk_cancellation_after_join"] == 1
    zero_price = spark.createDataFrame([(1, "Basic", D("0.00"), None)], t.subscription_plans.schema)
    orphan_t = ChurnTables(
        wide=t.wide, customers=t.customers.filter("customer_id <> 2"), subscriptions=t.subscriptions,
        subscription_plans=zero_price, usage_metrics=t.usage_metrics,
    )
    fk = {r.constraint_name: r.violations for r in constraints.check_foreign_key(orphan_t).collect()}
    assert fk["subscriptions.customer_id -> customers"] == 1
    assert fk["subscriptions.plan_id -> subscription_plans"] == 0
    rng2 = {r.constraint_name: r.violations for r in constraints.check_range(orphan_t).collect()}
    assert rng2["subscription_plans.price > 0"] == 1


def test_churn_probability_extremes(make_tables):
    rows = [
        base_row(1, avg_monthly_logins=D("0.0"), plan_name="Premium", tenure_months=1, billing_issues_count=2,
                 age_group="18-24", region="International"),
        base_row(2, avg_monthly_logins=D("20.0"), plan_name="Basic", tenure_months=30, age_group="45-54"),
        base_row(3, avg_monthly_logins=D("3.0"), plan_name="Basic", tenure_months=6, age_group="45-54"),
        base_row(4, avg_monthly_logins=D("8.0"), plan_name="Basic", tenure_months=12, age_group="45-54"),
    ]
    out = {r.customer_id: r.churn_probability for r in risk.churn_probability(make_tables(rows)).collect()}
    assert out == {1: 0.95, 2: 0.10, 3: pytest.approx(0.33), 4: pytest.approx(0.10)}
    assert out[3] == 0.33 and out[4] == 0.1


def test_lifetime_and_revenue_kpis(make_tables):
    rows = [
        base_row(1, plan_name="Premium", plan_price=D("22.99"), customer_lifetime_days=100),
        base_row(2, plan_name="Premium", plan_price=D("22.99"), customer_lifetime_days=201),
        base_row(3, plan_name="Premium", plan_price=D("22.99"), is_churned=True,
                 cancellation_date=dt.date(2023, 1, 1), customer_lifetime_days=45),
    ]
    t = make_tables(rows)
    life = {r.customer_status: r for r in kpis.lifetime_by_status(t).collect()}
    assert life["Active"].avg_lifetime_days == 151.0  # 150.5 rounds half up
    assert life["Active"].avg_lifetime_months == 5.0   # 150.5 / 30 = 5.0167
    mrr = kpis.mrr_by_plan(t).collect()
    assert [(r.plan_name, r.active_subscribers, r.monthly_revenue, r.churn_rate_pct) for r in mrr] == [
        ("Premium", 2, 45.98, 0.0)]
    lost = kpis.revenue_lost_by_plan(t).first()
    assert (lost.churned_customers, lost.monthly_revenue_lost, lost.annualized_revenue_lost) == (1, 22.99, 275.88)


@pytest.mark.parametrize("name", sorted(ANALYTICS))
def test_empty_input(spark, name):
    empty = ChurnTables.from_wide(spark.createDataFrame([], WIDE_SCHEMA))
    df = ANALYTICS[name](empty)
    rows = df.collect()
    assert len(df.columns) > 0
    assert len(rows) <= 49


def test_empty_input_cleaning_and_constraints(spark):
    raw = spark.createDataFrame([], RAW_SCHEMA)
    assert cleaning.clean(raw).count() == 0
    assert cleaning.clean(raw, dedup="key").count() == 0
    report = {r.metric: r.value for r in cleaning.cleaning_report(raw).collect()}
    assert report["rows_in"] == 0 and report["rows_out"] == 0
    empty = ChurnTables.from_wide(spark.createDataFrame([], WIDE_SCHEMA))
    for check in (constraints.check_primary_key, constraints.check_not_null, constraints.check_range,
                  constraints.check_date_order, constraints.check_width, constraints.check_foreign_key):
        rows = check(empty).collect()
        assert rows and all(r.violations == 0 for r in rows), check.__name__
