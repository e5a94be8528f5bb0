"""Cleaning of raw customer records, in the reference's order:

1. exact-row dedup over all columns, *before* any normalisation (NULL = NULL);
2. plan names title-cased;
3. join dates parsed from mixed formats, strictly (an unparseable value fails
   the job through ``raise_error`` instead of an eager check);
4. cancellation dates parsed, bad values -> NULL;
5. missing prices filled from the plan lookup (unknown plan stays NULL);
6. missing regions filled with 'Unknown';
7. rows whose cancellation precedes joining are repaired: cancellation date
   and reason -> NULL, churn flag -> false (lifetime is *not* recomputed).

Only step 1 shuffles (a hash aggregate on all columns; a group of identical
rows collapses in the map-side partial aggregate, however large it is).  The
lookup in step 5 is the seeded three-row plan table, broadcast.

``dedup="key"`` additionally keeps one row per ``customer_id`` after
normalisation, chosen by a documented total order (known region first, then
known price, then the smallest row); it is an aggregate, not a window, so a
customer id with a third of all rows is reduced map-side as well.

``observed_clean`` gives the cleaned records and the report's figures from one
scan and one dedup; ``cleaning_report`` computes the figures alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.dates import parse_mixed_date
from churnlens.schemas import UNKNOWN_REGION, WIDE_COLUMNS
from churnlens.sources.warehouse import plans_frame


def exact_dedup(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (all columns)."""
    return df.dropDuplicates()


def title_case_plan(df: DataFrame) -> DataFrame:
    """Title-case plan names ('basic' -> 'Basic')."""
    return df.withColumn("plan_name", F.initcap("plan_name"))


def parse_join_date(df: DataFrame, strict: bool = True) -> DataFrame:
    """Mixed-format join dates to DATE; with ``strict`` an unparseable non-empty value fails."""
    raw = F.col("join_date")
    parsed = parse_mixed_date(raw)
    if strict:
        bad = parsed.isNull() & raw.isNotNull() & (F.trim(raw.cast("string")) != "")
        # a filter, since a check inside a projected column is lost where the column is not read
        df = df.filter(F.when(bad, F.raise_error(F.concat(F.lit("unparseable join_date: "), raw.cast("string")))
                              .cast("boolean")).otherwise(F.lit(True)))
    return df.withColumn("join_date", parsed.cast("date"))


def parse_cancellation_date(df: DataFrame) -> DataFrame:
    """C4: cancellation dates to DATE, unparseable -> NULL."""
    return df.withColumn("cancellation_date", parse_mixed_date("cancellation_date"))


def fill_price_from_plan(df: DataFrame) -> DataFrame:
    """Fill NULL prices by plan name (after title-casing); an unknown plan stays NULL."""
    lookup = F.broadcast(
        plans_frame(df.sparkSession).select(F.col("plan_name").alias("_plan"), F.col("price").alias("_price"))
    )
    joined = df.join(lookup, df["plan_name"] == lookup["_plan"], "left")
    filled = F.coalesce(F.col("plan_price"), F.col("_price").cast(df.schema["plan_price"].dataType))
    return joined.withColumn("plan_price", filled).select(*df.columns)


def fill_region(df: DataFrame) -> DataFrame:
    """NULL region -> 'Unknown'."""
    return df.fillna({"region": UNKNOWN_REGION})


def invalid_cancellation(cancel: str = "cancellation_date", join: str = "join_date") -> F.Column:
    """Cancellation present and strictly before joining."""
    return F.col(cancel).isNotNull() & (F.col(cancel) < F.col(join))


def repair_dates(df: DataFrame) -> DataFrame:
    """Repair rows flagged by C7 (date, reason -> NULL; churned -> false)."""
    bad = F.coalesce(invalid_cancellation(), F.lit(False))
    return df.select(*[
        F.when(bad, F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in ("cancellation_date", "cancellation_reason")
        else F.when(bad, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "is_churned"
        else F.col(c)
        for c in df.columns
    ])


def normalise(df: DataFrame, strict_dates: bool = True) -> DataFrame:
    """C2-C8 (the row-local steps)."""
    return (
        df.transform(title_case_plan)
        .transform(lambda d: parse_join_date(d, strict=strict_dates))
        .transform(parse_cancellation_date)
        .transform(fill_price_from_plan)
        .transform(fill_region)
        .transform(repair_dates)
    )


def key_dedup(df: DataFrame, key: str = "customer_id", summed: list[str] | None = None) -> DataFrame:
    """Keep one row per key: known region, then known price, then the smallest row.

    Rows without a key are not one customer: all of them stay.  Columns in
    ``summed`` are added up over the rows that become one.
    """
    summed = summed or []
    others = [c for c in df.columns if c != key and c not in summed]
    pick = F.min(F.struct(
        (F.col("region") == UNKNOWN_REGION).alias("_unknown_region"),
        F.col("plan_price").isNull().alias("_price_absent"),
        *[F.col(c) for c in others],
    )).alias("_best")
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(pick, *[F.sum(c).alias(c) for c in summed])
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in others], *summed).select(*df.columns) \
        .union(df.filter(F.col(key).isNull()))


def clean(df: DataFrame, dedup: str = "exact", strict_dates: bool = True) -> DataFrame:
    """The whole cleaning pipeline."""
    if dedup not in ("exact", "key"):
        raise ValueError("dedup must be 'exact' or 'key'")
    out = normalise(exact_dedup(df), strict_dates=strict_dates)
    if dedup == "key":
        out = key_dedup(out)
    return out.select(*WIDE_COLUMNS)


# -- cleaning and its report in one pass ---------------------------------------

REPORT_STEPS = [(0, "rows_in"), (1, "duplicates_removed"), (4, "prices_filled"), (5, "regions_filled"),
                (6, "invalid_dates_repaired"), (7, "rows_out")]
_COUNTERS = ["_copies", "_distinct", "_no_price", "_no_region", "_bad_dates"]


def counted_dedup(df: DataFrame) -> DataFrame:
    """C1 with the number of copies of each row in ``_copies``."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))


def observed_clean(df: DataFrame, dedup: str = "exact", strict_dates: bool = True) -> tuple[DataFrame, Observation]:
    """C9 and C10 in one pass: the cleaned records, and the figures of the report once they are written.

    Each row carries what it stands for (its copies, whether a price, region or
    date was repaired) up to the last step, where the sums are observed.  They are
    observed in the stage that writes, whose tasks count once however often
    they are repeated; a count before the shuffle would add up the tasks that a lost
    executor makes run again.  ``reported`` gives the report.
    """
    if dedup not in ("exact", "key"):
        raise ValueError("dedup must be 'exact' or 'key'")
    counted = counted_dedup(df).withColumns({
        "_distinct": F.lit(1).cast("bigint"),
        "_no_price": F.col("plan_price").isNull().cast("bigint"),
        "_no_region": F.col("region").isNull().cast("bigint")})
    parsed = counted.transform(title_case_plan).transform(lambda d: parse_join_date(d, strict=strict_dates)) \
        .transform(parse_cancellation_date)
    marked = parsed.withColumn("_bad_dates", F.coalesce(invalid_cancellation(), F.lit(False)).cast("bigint"))
    out = marked.transform(fill_price_from_plan).transform(fill_region).transform(repair_dates)
    if dedup == "key":
        out = key_dedup(out, summed=_COUNTERS)
    figures = Observation()
    seen = out.observe(figures, *[F.sum(c).alias(c[1:]) for c in _COUNTERS])
    return seen.select(*WIDE_COLUMNS), figures


def reported(spark: SparkSession, figures: Observation) -> DataFrame:
    """The report of an ``observed_clean`` whose records have been written."""
    got = {k: v or 0 for k, v in figures.get.items()}
    values = [got["copies"], got["copies"] - got["distinct"], got["no_price"], got["no_region"], got["bad_dates"], got["distinct"]]
    return spark.createDataFrame([(step, metric, v) for (step, metric), v in zip(REPORT_STEPS, values)],
                                 "step long, metric string, value long")


def cleaning_report(df: DataFrame) -> DataFrame:
    """(step, metric, value) counts of the cleaning run.

    ``prices_filled`` counts NULL prices after dedup and before the fill, so
    rows of an unknown plan are included although they stay NULL.
    """
    rows_in = df.agg(F.count(F.lit(1))).scalar()
    deduped = exact_dedup(df)
    parsed = parse_cancellation_date(parse_join_date(title_case_plan(deduped), strict=False))
    one = parsed.agg(
        rows_in.alias("rows_in"),
        F.count(F.lit(1)).alias("rows_after_dedup"),
        F.sum(F.col("plan_price").isNull().cast("bigint")).alias("prices_filled"),
        F.sum(F.col("region").isNull().cast("bigint")).alias("regions_filled"),
        F.sum(F.coalesce(invalid_cancellation(), F.lit(False)).cast("bigint")).alias("invalid_dates"),
    )
    metrics = [
        (0, "rows_in", F.col("rows_in")),
        (1, "duplicates_removed", F.col("rows_in") - F.col("rows_after_dedup")),
        (4, "prices_filled", F.col("prices_filled")),
        (5, "regions_filled", F.col("regions_filled")),
        (6, "invalid_dates_repaired", F.col("invalid_dates")),
        (7, "rows_out", F.col("rows_after_dedup")),
    ]
    cells = F.array(*[
        F.struct(F.lit(s).cast("bigint").alias("step"), F.lit(m).alias("metric"),
                 F.coalesce(v, F.lit(0)).cast("bigint").alias("value"))
        for s, m, v in metrics
    ])
    return one.select(F.explode(cells).alias("c")).select("c.*").orderBy("step")
