"""Command line for the three jobs a user of the reference runs.

  python -m churnlens clean   --input RAW_CSV_DIR   --output DIR [--dedup exact|key]
      raw customer records -> cleaned records (CSV), plan lookup (CSV), cleaning report
  python -m churnlens analyze --input CLEAN_CSV_DIR --output DIR
      cleaned records -> summary, correlations, chart frames (Parquet) and findings report (text)
  python -m churnlens load    --input CLEAN_CSV_DIR | --sf-dir TABLES_DIR  --output DIR
      cleaned records or source tables -> the four relational tables with surrogate keys and load
      times, as the next load of the warehouse DIR (plans.loads); a repeated load replaces the
      tables in one step and keeps the keys of known customers
  python -m churnlens report  --input CLEAN_CSV_DIR | --sf-dir TABLES_DIR  --output DIR [--only NAME ...]
      the same -> loaded tables -> every registered analytics query (Parquet) + findings

``load`` and ``report`` refuse cleaned records with repeated or absent customer ids.
The tables written on the way are dropped at the end.

Run under ``spark-submit`` on a cluster (the master comes from the submit
configuration); every result is written by the executors, nothing is
collected to the driver.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.operators import report
from churnlens.operators.cleaning import observed_clean, reported
from churnlens.plans.catalog import ANALYTICS, normalize_types
from churnlens.plans.loads import Warehouse
from churnlens.plans.tables import ChurnTables
from churnlens.session import build_session
from churnlens.sources.files import read_customers_csv, write_csv, write_findings, write_plans_csv
from churnlens.sources.warehouse import plans_frame

# The analysis frames of the cleaned-records job (charts and report data).
ANALYSIS_QUERIES = [
    "dataset_summary", "plan_value_counts", "region_value_counts", "null_profile",
    "churn_correlations", "top3_churn_factors", "correlation_matrix",
    "login_tier_right_closed", "tenure_tier_right_closed", "billing_tier_fixed_domain",
    "plan_churn_stats", "region_churn_ascending", "engagement_bins", "engagement_trend",
]


def _write_results(tables: ChurnTables, names: list[str], output: str,
                   ops: dict[str, Callable[[ChurnTables], DataFrame]]) -> None:
    for name in names:
        normalize_types(ops[name](tables)).write.mode("overwrite").parquet(os.path.join(output, name))
    write_findings(report.findings(tables), os.path.join(output, "churn_summary_report"))


def run_clean(spark: SparkSession, input_path: str, output: str, dedup: str = "exact") -> None:
    raw = read_customers_csv(spark, input_path, parse_dates=False)
    cleaned, figures = observed_clean(raw, dedup=dedup)
    write_csv(cleaned.withColumn("is_churned", F.col("is_churned").cast("int")),
              os.path.join(output, "customers_clean"))
    write_plans_csv(plans_frame(spark), os.path.join(output, "subscriptions"))
    write_csv(reported(spark, figures), os.path.join(output, "cleaning_report"))


def run_analyze(spark: SparkSession, input_path: str, output: str) -> None:
    wide = read_customers_csv(spark, input_path, parse_dates=True)
    tables = ChurnTables.from_wide(wide).materialize(bucketed=False)
    try:
        _write_results(tables, ANALYSIS_QUERIES, output, ANALYTICS)
    finally:
        tables.drop()


def _lazy(spark: SparkSession, sf_dir: str | None, input_path: str | None) -> ChurnTables:
    if input_path:
        return ChurnTables.from_wide(read_customers_csv(spark, input_path, parse_dates=True))
    return ChurnTables.derive(spark, sf_dir)


@contextmanager
def _loaded(spark: SparkSession, sf_dir: str | None, input_path: str | None) -> Iterator[ChurnTables]:
    """The loaded tables of a folder of source tables or of cleaned CSV records, dropped afterwards."""
    tables = _lazy(spark, sf_dir, input_path).materialize()
    try:
        yield tables
    finally:
        tables.drop()


def run_load(spark: SparkSession, sf_dir: str | None, output: str, input_path: str | None = None) -> None:
    """The next load of the warehouse ``output``, its tables also as Parquet folders."""
    warehouse = Warehouse(spark, output)
    warehouse.release(warehouse.load(_lazy(spark, sf_dir, input_path), export=True))


def run_report(spark: SparkSession, sf_dir: str | None, output: str, only: list[str] | None = None,
               input_path: str | None = None) -> None:
    names = only or sorted(ANALYTICS)
    unknown = [n for n in names if n not in ANALYTICS]
    if unknown:
        raise ValueError(f"unknown queries: {unknown}")
    with _loaded(spark, sf_dir, input_path) as tables:
        _write_results(tables, names, output, ANALYTICS)


def _add_source(parser: argparse.ArgumentParser) -> None:
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--sf-dir")
    source.add_argument("--input")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="churnlens")
    sub = parser.add_subparsers(dest="command", required=True)
    p_clean = sub.add_parser("clean")
    p_clean.add_argument("--input", required=True)
    p_clean.add_argument("--output", required=True)
    p_clean.add_argument("--dedup", choices=["exact", "key"], default="exact")
    p_an = sub.add_parser("analyze")
    p_an.add_argument("--input", required=True)
    p_an.add_argument("--output", required=True)
    p_load = sub.add_parser("load")
    _add_source(p_load)
    p_load.add_argument("--output", required=True)
    p_rep = sub.add_parser("report")
    _add_source(p_rep)
    p_rep.add_argument("--output", required=True)
    p_rep.add_argument("--only", nargs="*")
    args = parser.parse_args(argv)

    spark = build_session(app_name=f"churnlens-{args.command}")
    if args.command == "clean":
        run_clean(spark, args.input, args.output, args.dedup)
    elif args.command == "analyze":
        run_analyze(spark, args.input, args.output)
    elif args.command == "load":
        run_load(spark, args.sf_dir, args.output, args.input)
    else:
        run_report(spark, args.sf_dir, args.output, args.only, args.input)


if __name__ == "__main__":
    main()
