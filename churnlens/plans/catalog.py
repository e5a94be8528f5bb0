"""Registry of named queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables for ``sf_dir`` (through the table
bundle, derived once per session and data folder and materialised below the
checkpoint folder), so its work grows with them.  Output columns are
normalised to BIGINT / DOUBLE / STRING / DATE / BOOLEAN.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.operators import (
    appended,
    audit,
    cleaning,
    constraints,
    extras,
    kpis,
    report,
    risk,
    rollup,
    segments,
    statistics,
    timeseries,
)
from churnlens.plans.loads import Warehouse
from churnlens.plans.tables import ChurnTables
from churnlens.session import hadoop_path, scratch_path
from churnlens.sources.dirty import make_dirty
from churnlens.sources.faulty import faulty_intake, faulty_plans, faulty_tables
from churnlens.sources.files import findings_lines, write_csv_checked
from churnlens.sources.tpch import SOURCE_TABLES, read_table
from churnlens.sources.warehouse import list_tables, load_customers, load_subscriptions, load_usage_metrics

TableOp = Callable[[ChurnTables], DataFrame]

ANALYTICS: dict[str, TableOp] = {
    # SQL report (Q1.1 - Q4.4)
    "overall_churn": kpis.overall_churn,
    "lifetime_by_status": kpis.lifetime_by_status,
    "mrr_by_plan": kpis.mrr_by_plan,
    "revenue_lost_by_plan": kpis.revenue_lost_by_plan,
    "churn_by_region_ranked": segments.churn_by_region_ranked,
    "churn_by_age_group": segments.churn_by_age_group,
    "churn_by_tenure_bucket": segments.churn_by_tenure_bucket,
    "churn_by_region_plan": segments.churn_by_region_plan,
    "monthly_churn_cumulative": timeseries.monthly_churn_cumulative,
    "monthly_net_growth": timeseries.monthly_net_growth,
    "rolling_30row_churn": timeseries.rolling_30row_churn,
    "churn_by_login_tier": segments.churn_by_login_tier,
    "churn_by_billing_tier": segments.churn_by_billing_tier,
    "high_risk_customers": risk.high_risk_customers,
    "cancellation_reasons": risk.cancellation_reasons,
    # analysis frames
    "dataset_summary": statistics.dataset_summary,
    "plan_value_counts": statistics.plan_value_counts,
    "region_value_counts": statistics.region_value_counts,
    "null_profile": statistics.null_profile_wide,
    "churn_correlations": statistics.churn_correlations,
    "top3_churn_factors": statistics.top3_churn_factors,
    "correlation_matrix": statistics.correlation_matrix,
    "login_tier_right_closed": segments.login_tier_right_closed,
    "tenure_tier_right_closed": segments.tenure_tier_right_closed,
    "billing_tier_fixed_domain": segments.billing_tier_fixed_domain,
    "plan_churn_stats": segments.plan_churn_stats,
    "region_churn_ascending": segments.region_churn_ascending,
    "engagement_bins": statistics.engagement_bins,
    "engagement_trend": statistics.engagement_trend,
    "findings": report.findings,
    "churn_probability": risk.churn_probability,
    # loading (S3 - S5)
    "load_customers": lambda t: load_customers(t.wide),
    "load_subscriptions": lambda t: load_subscriptions(t.wide, t.subscription_plans),
    "load_usage_metrics": lambda t: load_usage_metrics(t.wide),
    # extras stated in prose
    "segment_lift": extras.segment_lift,
    "rolling_30day_calendar": timeseries.rolling_30day_calendar,
    "region_plan_crosstab": extras.region_plan_crosstab,
}


def _dirty(t: ChurnTables) -> DataFrame:
    return make_dirty(t.wide)


def _dedup(t: ChurnTables) -> DataFrame:
    return cleaning.exact_dedup(_dirty(t))


CLEANING: dict[str, TableOp] = {
    "clean_exact_dedup": _dedup,
    "clean_mixed_dates": lambda t: cleaning.parse_cancellation_date(cleaning.parse_join_date(_dedup(t)))
    .select("customer_id", "join_date", "cancellation_date"),
    "clean_price_fill": lambda t: cleaning.fill_price_from_plan(cleaning.title_case_plan(_dedup(t)))
    .select("customer_id", "plan_name", "plan_price"),
    "clean_region_fill": lambda t: cleaning.fill_region(_dedup(t)).select("customer_id", "region"),
    "clean_date_repair": lambda t: cleaning.repair_dates(
        cleaning.parse_cancellation_date(cleaning.parse_join_date(_dedup(t)))
    ).select("customer_id", "join_date", "is_churned", "cancellation_date", "cancellation_reason"),
    "clean_records": lambda t: cleaning.clean(_dirty(t)),
    "clean_records_key_dedup": lambda t: cleaning.clean(_dirty(t), dedup="key"),
    "cleaning_report": lambda t: cleaning.cleaning_report(_dirty(t)),
}


def cleaned_tables(t: ChurnTables) -> ChurnTables:
    """The dirty records cleaned (exact dedup), in the relational tables."""
    return ChurnTables.from_wide(cleaning.clean(_dirty(t)))


# Constraint checks run on the tables loaded from the *cleaned* records (the
# reference declares them on the tables it loads its cleaned file into).
CONSTRAINTS: dict[str, TableOp] = {
    "check_primary_key": constraints.check_primary_key,
    "check_foreign_key": constraints.check_foreign_key,
    "check_not_null": constraints.check_not_null,
    "check_range": constraints.check_range,
    "check_date_order": constraints.check_date_order,
    "check_width": constraints.check_width,
}


# The second of two loads: what joined before this day was loaded first.
SECOND_LOAD_FROM = "1995-01-01"


def load_keys(t: ChurnTables) -> DataFrame:
    """The surrogate keys of each customer, as stored by the load."""
    return t.records.select("customer_id", "subscription_id", "metric_id")


def loaded_tables(t: ChurnTables) -> DataFrame:
    """The relations of the loaded database."""
    return list_tables(t.wide.sparkSession, t.database).filter("table_name <> 'records'")


def load_times(t: ChurnTables) -> DataFrame:
    """For each table its rows and whether all of them carry the load's one time."""
    at = t.records.agg(F.max("loaded_at")).scalar()
    frames = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                     (F.count(F.lit(1)) == F.count(F.when(F.col(stamp) == at, 1))).alias("one_load_time"))
              for name, df, stamp in (("customers", t.customers, "created_at"), ("usage_metrics", t.usage_metrics, "recorded_at"),
                                      ("subscription_plans", t.subscription_plans, "created_at"))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def report_lines(t: ChurnTables) -> DataFrame:
    """The lines of the findings report, dated with the latest day in the data."""
    latest = t.wide.agg(F.greatest(F.max("join_date"), F.max("cancellation_date"))).scalar()
    return findings_lines(report.findings(t), latest).select(F.col("value").alias("line"))


def audit_counts_faulty(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """K2-K6 over the damaged records, all relations in one scan."""
    return audit.audit_counts(audit.audit(rows, plans))


def rejects_faulty(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The damaged records that a load rejects, with the constraints that they break."""
    found = audit.rejects(audit.audit(rows, plans))
    return found.select("record_id", F.array_join(F.array_sort("broken"), "; ").alias("broken"))


AUDITS = {"audit_counts_faulty": audit_counts_faulty, "rejects_faulty": rejects_faulty}


def redelivered(t: ChurnTables) -> DataFrame:
    """A delivery as an intake: records of the last year again, once under their ids and once under new ones.

    Subscriptions of churned customers name an id that no customer has.
    """
    again = t.records.filter("tenure_months < 12").withColumn("customer_id", F.explode(F.array("customer_id", -F.col("customer_id"))))
    rows = audit.intake(again)
    lost = F.col("subscriptions").withField("customer_id", F.lit(-1_000_000_000) - F.abs("record_id"))
    return rows.withColumn("subscriptions", F.when(F.col("customers.is_churned"), lost).otherwise(F.col("subscriptions")))


def check_appended(t: ChurnTables) -> DataFrame:
    """K1 and K6 of a delivery against the loaded tables."""
    return appended.check_appended(t, redelivered(t))


def awkward_texts(t: ChurnTables) -> DataFrame:
    """Customer ids with texts that a CSV file must quote: one of each kind in turn."""
    label = F.concat_ws(" ", "region", "plan_name")
    kinds = [label, F.concat(F.lit('say "'), label, F.lit('"')), F.concat(label, F.lit("\nnext, line")), F.lit(""),
             F.lit(None).cast("string"), F.concat(F.lit("  "), label, F.lit(" ")), F.concat(F.lit("\\"), label, F.lit('\\"')),
             F.lit("#"), F.concat(F.lit("'"), label, F.lit(";\t|"))]
    text = F.get(F.array(*kinds), F.pmod("customer_id", F.lit(len(kinds))).cast("int"))
    return t.wide.select("customer_id", text.alias("text"), "join_date", "plan_price", "is_churned")


def csv_round_trip(t: ChurnTables) -> DataFrame:
    """Records written as CSV and read back, checked by fingerprint."""
    spark = t.wide.sparkSession
    path = scratch_path(spark, "csv")
    fs, folder = hadoop_path(spark, path)
    fs.deleteOnExit(folder)
    return write_csv_checked(awkward_texts(t), path)


LOADING: dict[str, TableOp] = {
    "load_keys": load_keys,
    "load_times": load_times,
    "loaded_tables": loaded_tables,
    "report_lines": report_lines,
    "csv_round_trip": csv_round_trip,
    "check_appended": check_appended,
}


def normalize_types(df: DataFrame) -> DataFrame:
    """Integral -> BIGINT, decimal/float -> DOUBLE; everything else unchanged."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def source_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Count, bytes, latest change and digest of the source files: a listing, no file is read."""
    paths = [os.path.join(sf_dir, f"{name}.parquet") for name in SOURCE_TABLES]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return tuple(files.agg(
        F.count("*"), F.sum("length"), F.max("modificationTime"),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")),
    ).first())


class TableCache:
    """Load each table bundle once per (session, state of the data folder), like a load step.

    ``get`` gives the tables derived from the driver's data; ``get_cleaned``
    the tables loaded from the cleaned dirty records; ``get_faulty`` tables
    that break the declared constraints.  With ``materialize`` the first two are
    loaded below the shared checkpoint folder (lineage cut); what the other calls
    need is written there once as well.  A changed source
    file makes the next call load again; ``drop`` drops all written tables, those
    of earlier states included (a result may still read them until then).
    """

    def __init__(self, materialize: bool = True):
        self._materialize = materialize
        self._lock = threading.RLock()
        self._cache: dict[tuple, ChurnTables] = {}
        self._written: dict[tuple, str] = {}

    @staticmethod
    def _key(spark: SparkSession, sf_dir: str, kind: str) -> tuple:
        return spark.sparkContext.applicationId, sf_dir.rstrip("/"), kind, source_state(spark, sf_dir)

    def drop(self) -> None:
        with self._lock:
            for tables in self._cache.values():
                tables.drop()
            spark = SparkSession.getActiveSession()
            for path in self._written.values():
                fs, folder = hadoop_path(spark, path)
                fs.delete(folder, True)
            self._cache.clear()
            self._written.clear()

    def _load(self, spark: SparkSession, key: tuple, build: Callable[[], ChurnTables],
              unique_key: bool) -> ChurnTables:
        with self._lock:
            cached = self._cache.get(key)
            if cached is not None and cached.database and not spark.catalog.databaseExists(cached.database):
                cached = None  # the catalog was reset: load again
            if cached is None:
                tables = build()
                cached = tables.materialize(bucketed=unique_key) if self._materialize else tables
                self._cache[key] = cached
            return cached

    def get(self, spark: SparkSession, sf_dir: str) -> ChurnTables:
        return self._load(spark, self._key(spark, sf_dir, "derived"),
                          lambda: ChurnTables.derive(spark, sf_dir), unique_key=True)

    def get_cleaned(self, spark: SparkSession, sf_dir: str) -> ChurnTables:
        return self._load(spark, self._key(spark, sf_dir, "cleaned"),
                          lambda: cleaned_tables(self.get(spark, sf_dir)), unique_key=False)

    def get_clean_report(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The report of a cleaning run that wrote its records (one scan, one dedup)."""
        cleaned, figures = cleaning.observed_clean(_dirty(self.get(spark, sf_dir)))
        path = scratch_path(spark, "cleaned")
        cleaned.write.parquet(path)
        fs, folder = hadoop_path(spark, path)
        fs.delete(folder, True)
        return cleaning.reported(spark, figures)

    def get_rollup(self, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        """The roll-up of the early joiners, stored, then refreshed by the later ones alone; and the plans."""
        key = self._key(spark, sf_dir, "rollup")
        with self._lock:
            path = self._written.get(key)
            tables = self.get(spark, sf_dir)
            if path is None:
                early = F.coalesce(F.col("join_date") < SECOND_LOAD_FROM, F.lit(False))
                path = scratch_path(spark, "rollup")
                rollup.roll_up(tables.records.filter(early)).write.parquet(f"{path}/first")
                stored = spark.read.parquet(f"{path}/first")
                rollup.refresh(stored, tables.records.filter(~early)).write.parquet(f"{path}/refreshed")
                self._written[key] = path
            return spark.read.parquet(f"{path}/refreshed"), tables.subscription_plans

    def get_two_loads(self, spark: SparkSession, sf_dir: str) -> tuple[ChurnTables, DataFrame]:
        """The tables after two loads into one warehouse (early joiners, then everybody), and the loads' history."""
        key = self._key(spark, sf_dir, "two_loads")
        with self._lock:
            tables = self._cache.get(key)
            if tables is None or not spark.catalog.databaseExists(tables.database):
                wide = self.get(spark, sf_dir).wide
                warehouse = Warehouse(spark, scratch_path(spark, "two-loads"))
                early = wide.filter(F.col("join_date") < SECOND_LOAD_FROM)
                warehouse.load(ChurnTables.from_wide(early), written=self._materialize)
                tables = self._cache[key] = warehouse.load(ChurnTables.from_wide(wide), written=self._materialize)
                warehouse.vacuum()
            return tables, Warehouse(spark, os.path.dirname(tables.folder)).history()

    def get_faulty_intake(self, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        """The damaged records as an intake, written once, and the plans with bad rows."""
        key = self._key(spark, sf_dir, "faulty")
        with self._lock:
            tables = self.get(spark, sf_dir)
            path = self._written.get(key)
            if path is None:
                path = scratch_path(spark, "faulty")
                faulty_intake(tables).write.parquet(path)
                self._written[key] = path
            return spark.read.parquet(path), faulty_plans(tables)

    def get_faulty(self, spark: SparkSession, sf_dir: str) -> ChurnTables:
        return faulty_tables(self.get(spark, sf_dir), *self.get_faulty_intake(spark, sf_dir))


def registry(cache: TableCache | None = None) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    cache = cache or TableCache()

    def bind(op: TableOp, load: Callable[[SparkSession, str], ChurnTables] = cache.get
             ) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize_types(op(load(spark, sf_dir)))
        run.__doc__ = op.__doc__
        return run

    out = {name: bind(op) for name, op in {**ANALYTICS, **CLEANING, **LOADING}.items()}
    out.update({name: bind(op, cache.get_cleaned) for name, op in CONSTRAINTS.items()})
    out.update({f"{name}_faulty": bind(op, cache.get_faulty) for name, op in CONSTRAINTS.items()})
    def audited(made: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: normalize_types(made(*cache.get_faulty_intake(spark, sf_dir)))

    out.update({name: audited(made) for name, made in AUDITS.items()})

    def roll(made: rollup.Report) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: normalize_types(made(*cache.get_rollup(spark, sf_dir)))

    out.update({f"rolled_{name}": roll(made) for name, made in rollup.REPORTS.items()})
    out["clean_observed"] = lambda spark, sf_dir: cache.get_clean_report(spark, sf_dir)
    out["load_keys_next"] = lambda spark, sf_dir: normalize_types(load_keys(cache.get_two_loads(spark, sf_dir)[0]))
    out["load_history"] = lambda spark, sf_dir: normalize_types(cache.get_two_loads(spark, sf_dir)[1].select(
        "load_id", "customers", "subscriptions", "subscription_high", "metric_high"))
    out["inactive_users"] = lambda spark, sf_dir: normalize_types(
        extras.inactive_users(read_table(spark, sf_dir, "events"))
    )
    return out
