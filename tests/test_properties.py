"""Property-based checks of the Column builders against plain-Python references.

Each example builds one small DataFrame holding the whole generated list, so a
handful of examples exercise many values per Spark job.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from churnlens.functions import tiers
from churnlens.functions.dates import parse_mixed_date
from churnlens.functions.numeric import rate_pct, round_ratio
from churnlens.operators import statistics

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def _half_up(q: Fraction, digits: int) -> float:
    """Exact half-up rounding of a non-negative rational, then the nearest double."""
    scaled = q * 10 ** digits
    k = (2 * scaled.numerator + scaled.denominator) // (2 * scaled.denominator)
    return float(Fraction(k, 10 ** digits))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(1, 10**9)), min_size=1, max_size=60))
def test_rate_pct_is_exact_half_up(spark, pairs):
    rows = [(min(a, b), b) for a, b in pairs]
    df = spark.createDataFrame(rows, "c long, n long")
    got = [r.p for r in df.select(rate_pct("c", "n").alias("p")).collect()]
    assert got == [_half_up(Fraction(100 * c, n), 2) for c, n in rows]
    got6 = [r.p for r in df.select(round_ratio("c", "n", 6).alias("p")).collect()]
    assert got6 == [_half_up(Fraction(c, n), 6) for c, n in rows]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.decimals(min_value=-5, max_value=120, places=1,
                                                     allow_nan=False, allow_infinity=False)),
                min_size=1, max_size=80))
def test_right_closed_bins_match_pandas_cut(spark, values):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", T.DecimalType(18, 1))]))
    labels = tiers.LOGIN_TIER_LABELS
    got = [r.t for r in df.select(tiers.right_closed_bin("x", tiers.LOGIN_TIER_EDGES, labels).alias("t")).collect()]
    ref = pd.cut(pd.Series([None if v is None else float(v) for v in values], dtype="float64"),
                 bins=tiers.LOGIN_TIER_EDGES, labels=labels, right=True)
    assert got == [None if pd.isna(v) else v for v in ref]


def _probability(logins, plan, tenure, billing, age_group, region) -> Decimal:
    p = Decimal("0.10")
    if logins < 3:
        p += Decimal("0.35")
    elif logins < 8:
        p += Decimal("0.15")
    if plan == "Premium":
        p += Decimal("0.08")
    elif plan == "Standard":
        p += Decimal("0.04")
    if tenure < 6:
        p += Decimal("0.20")
    elif tenure < 12:
        p += Decimal("0.08")
    if billing > 0:
        p += Decimal("0.12")
    if age_group in ("18-24", "25-34"):
        p += Decimal("0.06")
    if region == "International":
        p += Decimal("0.10")
    return min(p, Decimal("0.95"))


@SETTINGS
@given(st.lists(st.tuples(
    st.decimals(min_value=0, max_value=40, places=1, allow_nan=False, allow_infinity=False),
    st.sampled_from(["Basic", "Standard", "Premium"]),
    st.integers(0, 60), st.integers(0, 4),
    st.sampled_from(["18-24", "25-34", "35-44", "65+"]),
    st.sampled_from(["West", "International"]),
), min_size=1, max_size=60))
def test_churn_probability_matches_rule(spark, rows):
    schema = ("avg_monthly_logins decimal(18,1), plan_name string, tenure_months int, "
              "billing_issues_count long, age_group string, region string")
    df = spark.createDataFrame(rows, schema)
    got = [r.p for r in df.select(tiers.churn_probability().alias("p")).collect()]
    assert got == [_probability(*r) for r in rows]


@SETTINGS
@given(st.lists(st.dates(min_value=dt.date(1900, 1, 1), max_value=dt.date(2100, 12, 31)), min_size=1, max_size=40),
       st.sampled_from(["%Y-%m-%d", "%m/%d/%Y", "%Y-%m-%d 00:00:00", "%-m/%-d/%Y"]))
def test_mixed_dates_round_trip(spark, dates, fmt):
    texts = [d.strftime(fmt) for d in dates]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r.d for r in df.select(parse_mixed_date("x").alias("d")).collect()] == dates


@SETTINGS
@given(st.lists(st.decimals(min_value=0, max_value=60, places=1, allow_nan=False, allow_infinity=False),
                min_size=1, max_size=60))
def test_equal_width_bins_counts_match_pandas(make_tables, values):
    from tests.test_boundaries import base_row
    t = make_tables([base_row(i, avg_monthly_logins=v, is_churned=i % 3 == 0) for i, v in enumerate(values)])
    got = {r.bin: r.n for r in statistics.engagement_bins(t).collect()}
    codes = pd.cut(pd.Series([float(v) for v in values]), bins=10, labels=False)
    assert got == {int(k) + 1: v for k, v in codes.value_counts().to_dict().items()}
    assert sum(got.values()) == len(values)
