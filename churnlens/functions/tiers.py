"""Bucketing, tiering and scoring expressions (pure Column builders).

Two closure rules coexist on purpose: the SQL report buckets are left-closed
``CASE WHEN x < edge`` chains whose ELSE catches NULL, while the chart tiers are
right-closed ``(lo, hi]`` intervals that leave values outside every interval
(and NULL) unassigned.  They are never merged.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens.schemas import AGE_GROUPS

# ---------------------------------------------------------------------------
# Bucket edges and labels.
# ---------------------------------------------------------------------------
TENURE_BUCKETS = [(3, "0-3 months"), (6, "3-6 months"), (12, "6-12 months"), (24, "1-2 years")]
TENURE_BUCKET_ELSE = "2+ years"
TENURE_BUCKET_ORDER = ["0-3 months", "3-6 months", "6-12 months", "1-2 years", "2+ years"]

LOGIN_TIERS = [(3, "Very Low (0-2/mo)"), (8, "Low (3-7/mo)"), (15, "Medium (8-14/mo)")]
LOGIN_TIER_ELSE = "High (15+/mo)"

BILLING_TIERS = ["No Issues", "1 Issue", "2+ Issues"]

LOGIN_TIER_EDGES = [0, 3, 8, 15, 100]
LOGIN_TIER_LABELS = ["Very Low (<3/mo)", "Low (3-7/mo)", "Medium (8-14/mo)", "High (15+/mo)"]
TENURE_TIER_EDGES = [0, 3, 6, 12, 24, 100]
TENURE_TIER_LABELS = ["0-3 months", "3-6 months", "6-12 months", "1-2 years", "2+ years"]

RISK_TENURE_BELOW = 6
RISK_LOGINS_BELOW = 5

# Rule-based churn probability weights.
PROB_BASE = Decimal("0.10")
PROB_LOGINS_BELOW_3 = Decimal("0.35")
PROB_LOGINS_BELOW_8 = Decimal("0.15")
PROB_PREMIUM = Decimal("0.08")
PROB_STANDARD = Decimal("0.04")
PROB_TENURE_BELOW_6 = Decimal("0.20")
PROB_TENURE_BELOW_12 = Decimal("0.08")
PROB_BILLING = Decimal("0.12")
PROB_YOUNG = Decimal("0.06")
PROB_YOUNG_GROUPS = ("18-24", "25-34")
PROB_INTERNATIONAL = Decimal("0.10")
PROB_CAP = Decimal("0.95")
# ---------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def left_closed_label(x: Column | str, edges_labels: list[tuple[float, str]], otherwise: str) -> Column:
    """``CASE WHEN x < e1 THEN l1 WHEN x < e2 THEN l2 ... ELSE otherwise END`` (NULL -> ELSE)."""
    col = _col(x)
    expr = None
    for edge, label in edges_labels:
        expr = F.when(col < edge, label) if expr is None else expr.when(col < edge, label)
    return expr.otherwise(otherwise)


def right_closed_bin(x: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]`` holding x; NULL outside all of them."""
    col = _col(x)
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (col > lo) & (col <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def tenure_bucket(tenure_months: Column | str = "tenure_months") -> Column:
    return left_closed_label(tenure_months, TENURE_BUCKETS, TENURE_BUCKET_ELSE)


def tenure_bucket_order(bucket: Column | str = "tenure_bucket") -> Column:
    col = _col(bucket)
    expr = None
    for i, label in enumerate(TENURE_BUCKET_ORDER[:-1], start=1):
        expr = F.when(col == label, i) if expr is None else expr.when(col == label, i)
    return expr.otherwise(len(TENURE_BUCKET_ORDER))


def login_tier(logins: Column | str = "avg_monthly_logins") -> Column:
    return left_closed_label(logins, LOGIN_TIERS, LOGIN_TIER_ELSE)


def billing_tier(billing: Column | str = "billing_issues_count") -> Column:
    """0 -> 'No Issues', 1 -> '1 Issue', anything else (NULL included) -> '2+ Issues'."""
    col = _col(billing)
    return F.when(col == 0, BILLING_TIERS[0]).when(col == 1, BILLING_TIERS[1]).otherwise(BILLING_TIERS[2])


def age_group(age: Column | str = "age") -> Column:
    col = _col(age)
    expr = None
    for label, lo, hi in AGE_GROUPS[:-1]:
        cond = (col >= lo) & (col <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    last_label, last_lo, _ = AGE_GROUPS[-1]
    return expr.when(col >= last_lo, last_label)


def risk_score(
    tenure_months: Column | str = "tenure_months",
    logins: Column | str = "avg_monthly_logins",
    billing: Column | str = "billing_issues_count",
) -> Column:
    """Additive 0..3 score; a NULL input contributes 0 (CASE ... ELSE 0)."""
    return (
        F.when(_col(tenure_months) < RISK_TENURE_BELOW, 1).otherwise(0)
        + F.when(_col(logins) < RISK_LOGINS_BELOW, 1).otherwise(0)
        + F.when(_col(billing) > 0, 1).otherwise(0)
    ).cast("bigint")


def churn_probability(
    logins: Column | str = "avg_monthly_logins",
    plan_name: Column | str = "plan_name",
    tenure_months: Column | str = "tenure_months",
    billing: Column | str = "billing_issues_count",
    age_grp: Column | str = "age_group",
    region: Column | str = "region",
) -> Column:
    """Rule-based churn probability in exact decimal arithmetic, capped at 0.95."""
    def d(v: Decimal) -> Column:
        return F.lit(v).cast("decimal(4,2)")

    zero = d(Decimal("0.00"))
    lg, tn = _col(logins), _col(tenure_months)
    total = (
        d(PROB_BASE)
        + F.when(lg < 3, d(PROB_LOGINS_BELOW_3)).when(lg < 8, d(PROB_LOGINS_BELOW_8)).otherwise(zero)
        + F.when(_col(plan_name) == "Premium", d(PROB_PREMIUM))
        .when(_col(plan_name) == "Standard", d(PROB_STANDARD)).otherwise(zero)
        + F.when(tn < 6, d(PROB_TENURE_BELOW_6)).when(tn < 12, d(PROB_TENURE_BELOW_12)).otherwise(zero)
        + F.when(_col(billing) > 0, d(PROB_BILLING)).otherwise(zero)
        + F.when(_col(age_grp).isin(*PROB_YOUNG_GROUPS), d(PROB_YOUNG)).otherwise(zero)
        + F.when(_col(region) == "International", d(PROB_INTERNATIONAL)).otherwise(zero)
    )
    return F.least(total, d(PROB_CAP))
