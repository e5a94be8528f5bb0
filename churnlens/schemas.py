"""Schemas and fixed domain values.

The wide customer record has the 17 columns of the generated customer file, in
that order.  The four relational tables follow the reference DDL; widths that
the DDL declares (VARCHAR(n), SMALLINT, NUMERIC(p,s)) are *checked* by the
constraint operators instead of being enforced by narrow storage types, so a
hot customer with an unusually large count cannot make a load fail.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
# ---------------------------------------------------------------------------
# Plans: name, monthly price, features text.
PLANS = [
    ("Basic", Decimal("9.99"), "1 screen, SD quality"),
    ("Standard", Decimal("15.99"), "2 screens, HD quality"),
    ("Premium", Decimal("22.99"), "4 screens, 4K quality"),
]
UNKNOWN_REGION = "Unknown"
PAYMENT_METHODS = ["Credit Card", "Debit Card", "PayPal", "Bank Transfer"]
# Age bands: label, lowest age, highest age.
AGE_GROUPS = [
    ("18-24", 18, 24),
    ("25-34", 25, 34),
    ("35-44", 35, 44),
    ("45-54", 45, 54),
    ("55-64", 55, 64),
    ("65+", 65, 80),
]
# Required columns of the analysis input.
REQUIRED_COLUMNS = [
    "customer_id", "is_churned", "plan_name", "plan_price",
    "region", "age_group", "tenure_months",
    "avg_monthly_logins", "avg_session_minutes",
    "support_tickets", "billing_issues_count",
]
# Features correlated with the churn flag, and the heat-map column set.
CORRELATION_FEATURES = [
    "plan_price",
    "tenure_months",
    "avg_monthly_logins",
    "avg_session_minutes",
    "support_tickets",
    "billing_issues_count",
    "customer_lifetime_days",
]
MATRIX_COLUMNS = [
    "is_churned", "plan_price", "tenure_months",
    "avg_monthly_logins", "avg_session_minutes",
    "support_tickets", "billing_issues_count",
]
# ---------------------------------------------------------------------------

PRICE_TYPE = T.DecimalType(6, 2)
# One decimal place as declared; precision kept wide (checked by K5).
METRIC_TYPE = T.DecimalType(18, 1)

WIDE_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("age_group", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("plan_name", T.StringType()),
    T.StructField("plan_price", PRICE_TYPE),
    T.StructField("payment_method", T.StringType()),
    T.StructField("join_date", T.DateType()),
    T.StructField("tenure_months", T.IntegerType()),
    T.StructField("avg_monthly_logins", METRIC_TYPE),
    T.StructField("avg_session_minutes", METRIC_TYPE),
    T.StructField("support_tickets", T.LongType()),
    T.StructField("billing_issues_count", T.LongType()),
    T.StructField("is_churned", T.BooleanType()),
    T.StructField("cancellation_date", T.DateType()),
    T.StructField("cancellation_reason", T.StringType()),
    T.StructField("customer_lifetime_days", T.IntegerType()),
])
WIDE_COLUMNS = [f.name for f in WIDE_SCHEMA.fields]

# Raw (dirty) record: the same columns, dates still text as read from a file.
RAW_SCHEMA = T.StructType([
    T.StructField(f.name, T.StringType()) if f.name in ("join_date", "cancellation_date") else f
    for f in WIDE_SCHEMA.fields
])

PLANS_SCHEMA = T.StructType([
    T.StructField("plan_id", T.LongType(), False),
    T.StructField("plan_name", T.StringType(), False),
    T.StructField("price", PRICE_TYPE, False),
    T.StructField("features", T.StringType()),
])

CUSTOMER_COLUMNS = [
    "customer_id", "age", "age_group", "region", "payment_method", "join_date",
    "tenure_months", "is_churned", "cancellation_date", "cancellation_reason",
    "customer_lifetime_days",
]
SUBSCRIPTION_COLUMNS = [
    "customer_id", "plan_id", "plan_name", "plan_price", "start_date", "end_date", "is_active",
]
USAGE_COLUMNS = [
    "customer_id", "avg_monthly_logins", "avg_session_minutes",
    "support_tickets", "billing_issues_count",
]

# Declared widths of the relational schema, checked by the width constraint.
VARCHAR_WIDTHS = {
    "subscription_plans": {"plan_name": 50},
    "customers": {"age_group": 10, "region": 30, "payment_method": 30, "cancellation_reason": 100},
    "subscriptions": {"plan_name": 50},
}
SMALLINT_COLUMNS = {
    "customers": ["age", "tenure_months"],
    "usage_metrics": ["support_tickets", "billing_issues_count"],
}
NUMERIC_WIDTHS = {
    "subscription_plans": {"price": (6, 2)},
    "subscriptions": {"plan_price": (6, 2)},
    "usage_metrics": {"avg_monthly_logins": (5, 1), "avg_session_minutes": (6, 1)},
}
