"""Descriptive statistics over the wide record: summary, value counts, NULL
profile, correlation with the churn flag, the correlation matrix and the
equal-width engagement bins with their linear trend.

Every statistic is a single aggregate pass (partial + final) whose small
result is reshaped afterwards; nothing loops over features with a job each and
nothing collects rows to the driver.  Correlations share one accumulator for each
pair of columns, bins and their trend one table of value frequencies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.numeric import flag, round_ratio
from churnlens.plans.tables import ChurnTables
from churnlens.schemas import CORRELATION_FEATURES, MATRIX_COLUMNS

N_ENGAGEMENT_BINS = 10


def _numeric(c: str) -> F.Column:
    return flag(c) if c == "is_churned" else F.col(c)


def dataset_summary(tables: ChurnTables) -> DataFrame:
    w = tables.wide
    total, churned = F.count(F.lit(1)), F.sum(flag("is_churned"))

    def mean6(c: str) -> F.Column:
        col = F.col(c).cast("decimal(28,4)")
        return round_ratio(F.sum(col), F.count(col), 6)

    return w.agg(
        total.alias("total"),
        churned.cast("bigint").alias("churned"),
        (total - churned).cast("bigint").alias("active"),
        round_ratio(churned, total, 6).alias("churn_rate"),
        mean6("tenure_months").alias("avg_tenure"),
        mean6("avg_monthly_logins").alias("avg_logins"),
        mean6("avg_session_minutes").alias("avg_session"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-NULL values with their counts, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "value")
    )


def plan_value_counts(tables: ChurnTables) -> DataFrame:
    return value_counts(tables.wide, "plan_name")


def region_value_counts(tables: ChurnTables) -> DataFrame:
    return value_counts(tables.wide, "region")


def null_profile(df: DataFrame) -> DataFrame:
    """Columns that hold NULLs, with their NULL counts (one aggregate pass)."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column_name", "null_count")
    return long.filter(F.col("null_count") > 0).select(
        "column_name", F.col("null_count").cast("bigint").alias("null_count")
    )


def null_profile_wide(tables: ChurnTables) -> DataFrame:
    return null_profile(tables.wide)


def _direction(r: F.Column) -> F.Column:
    return F.when(r > 0, "POSITIVE").otherwise("NEGATIVE")


def co_moments(df: DataFrame, columns: dict[str, F.Column], pairs: list[tuple[str, str]]) -> DataFrame:
    """One row for each pair: (pair, n, r), over the rows where both columns are present.

    Each row is unfolded into its pairs and one accumulator (count, means, squared
    deviations, co-moment) is kept for each of them: partial and final hash aggregate
    on the pair's number, merged like any aggregate, with the same small
    generated code for any number of columns.  ``r`` is Pearson's, NULL where a side is
    constant; a pair of a column with itself gives 1.
    """
    values = df.select(*[c.cast("double").alias(name) for name, c in columns.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y"))
                      for k, (a, b) in enumerate(pairs)])
    complete = values.select(F.inline(cells)).filter("x IS NOT NULL AND y IS NOT NULL")
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    return complete.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("x", "y"), F.when(spread != 0, spread)).alias("r"))


def _correlated(df: DataFrame, columns: dict[str, F.Column], pairs: list[tuple[str, str]]) -> DataFrame:
    """(feature_a, feature_b, r) for all ``pairs``, those without a complete row included (NULL)."""
    distinct = sorted({(min(p), max(p)) for p in pairs})
    # one row: a map with an entry a pair
    found = co_moments(df, columns, distinct).agg(F.map_from_entries(F.collect_list(F.struct("pair", "r"))).alias("r"))
    return found.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                 F.try_element_at("r", F.lit(distinct.index((min(a, b), max(a, b))))).alias("r"))
        for a, b in pairs])))


def churn_correlation(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, r): unrounded Pearson r of each feature with the churn flag."""
    columns = {f: F.col(f) for f in features} | {"is_churned": flag("is_churned")}
    return _correlated(df, columns, [(f, "is_churned") for f in features]).select(F.col("feature_a").alias("feature"), "r")


def churn_correlations(tables: ChurnTables, features: list[str] | None = None,
                       exclude: list[str] | None = None) -> DataFrame:
    """Pearson r of each feature with the churn flag, by |r| descending, with direction."""
    feats = [f for f in (features or CORRELATION_FEATURES) if f not in (exclude or [])]
    return (
        churn_correlation(tables.wide, feats).select(
            "feature",
            F.round("r", 6).alias("r"),
            _direction(F.col("r")).alias("direction"),
            F.abs("r").alias("_abs"),
        )
        .orderBy(F.col("_abs").desc_nulls_last(), "feature")
        .drop("_abs")
    )


def top3_churn_factors(tables: ChurnTables) -> DataFrame:
    top = churn_correlation(tables.wide, CORRELATION_FEATURES) \
        .orderBy(F.abs("r").desc_nulls_last(), "feature").limit(3)
    ranked = top.select(
        F.row_number().over(Window.orderBy(F.abs("r").desc_nulls_last(), "feature"))
        .cast("bigint").alias("rank"),
        "feature",
        F.round("r", 6).alias("r"),
    )
    return ranked.orderBy("rank")


def correlation_matrix(tables: ChurnTables, columns: list[str] | None = None) -> DataFrame:
    """Symmetric long-form matrix (feature_a, feature_b, r); diagonal 1, NULL for a constant column."""
    cols = columns or MATRIX_COLUMNS
    found = _correlated(tables.wide, {c: _numeric(c) for c in cols}, [(a, b) for a in cols for b in cols])
    r = F.when(F.col("feature_a") == F.col("feature_b"), F.when(F.col("r").isNotNull(), F.lit(1.0))).otherwise(F.round("r", 6))
    return found.select("feature_a", "feature_b", r.alias("r"))


def _login_frequencies(tables: ChurnTables) -> DataFrame:
    """(x, churned, flagged) for each distinct number of logins: what range, bins and fit are made from."""
    w = tables.wide.select(F.col("avg_monthly_logins").cast("double").alias("x"), flag("is_churned").alias("y"))
    table = w.filter(F.col("x").isNotNull()).groupBy("x").agg(F.sum("y").alias("churned"), F.count("y").alias("flagged"))
    # a small exchange that whoever reads the table shares, even where one partition holds all rows
    return table.repartition("x")


def _edges(mn: F.Column, mx: F.Column, n_bins: int) -> F.Column:
    """The ``n_bins + 1`` equal-width edges over [mn, mx].

    Edges are ``start + i * step`` with the last edge set to the maximum, as a
    linear grid does, and the lowest edge lowered by 0.1 % of the range so the
    minimum falls in bin 1.  With min = max the range is first widened by
    0.1 % on each side.
    """
    same = mn == mx
    widen_lo = F.when(mn != 0, mn - F.lit(0.001) * F.abs(mn)).otherwise(mn - F.lit(0.001))
    widen_hi = F.when(mx != 0, mx + F.lit(0.001) * F.abs(mx)).otherwise(mx + F.lit(0.001))
    start = F.when(same, widen_lo).otherwise(mn)
    stop = F.when(same, widen_hi).otherwise(mx)
    step = (stop - start) / F.lit(float(n_bins))
    first = F.when(same, start).otherwise(start - (mx - mn) * F.lit(0.001))
    return F.array(first, *[F.lit(float(i)) * step + start for i in range(1, n_bins)], stop)


def _binned_logins(tables: ChurnTables, n_bins: int = N_ENGAGEMENT_BINS) -> tuple[DataFrame, F.Column]:
    """(bin, churned, flagged) with right-closed bins 1..n_bins, and the edges.

    Range and bins both come from the frequency table.  The range (a scalar
    subquery) takes all its columns along, so both read the same aggregate and
    Spark runs it once.
    """
    frequencies = _login_frequencies(tables)
    whole = frequencies.agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.sum("churned").alias("churned"),
                            F.sum("flagged").alias("flagged"))
    found = whole.select(F.struct(_edges(F.col("mn"), F.col("mx"), n_bins).alias("edges"), "churned", "flagged")).scalar()
    edges = found["edges"]
    below = [F.when(F.element_at(edges, i + 1) < F.col("x"), 1).otherwise(0) for i in range(n_bins + 1)]
    binned = frequencies.withColumn("bin", sum(below[1:], below[0]))
    return binned.groupBy("bin").agg(F.sum("churned").alias("churned"), F.sum("flagged").alias("flagged")), edges


def _midpoint(edges: F.Column, bin_col: F.Column) -> F.Column:
    return (F.element_at(edges, bin_col) + F.element_at(edges, bin_col + 1)) * F.lit(0.5)


def engagement_bins(tables: ChurnTables, n_bins: int = N_ENGAGEMENT_BINS) -> DataFrame:
    """Mean and count of the churn flag in each bin (a NULL flag is skipped by both)."""
    binned, edges = _binned_logins(tables, n_bins)
    return binned.select(
        F.col("bin").cast("bigint").alias("bin"),
        F.round(_midpoint(edges, F.col("bin")), 6).alias("midpoint"),
        round_ratio(F.col("churned"), F.col("flagged"), 6, scale=100).alias("churn_pct"),
        F.col("flagged").alias("n"),
    ).orderBy("bin")


def engagement_trend(tables: ChurnTables, n_bins: int = N_ENGAGEMENT_BINS) -> DataFrame:
    """Unweighted least-squares line of churn % on bin midpoint (degree-1 fit)."""
    binned, edges = _binned_logins(tables, n_bins)
    per_bin = binned.select(
        _midpoint(edges, F.col("bin")).alias("mid"),
        (F.try_divide(F.col("churned").cast("double"), F.col("flagged").cast("double")) * F.lit(100.0)).alias("pct"),
    )
    return per_bin.agg(
        F.round(F.regr_slope("pct", "mid"), 6).alias("slope"),
        F.round(F.regr_intercept("pct", "mid"), 6).alias("intercept"),
    )
