"""File sources and sinks: customer CSV in, cleaned CSV / lookup / findings out.

CSV is read as text by the names in its header (every file's header is
checked against the first one's), never by position and never with
``inferSchema``.  Cells are cast with ``try_cast``; a cell that is not empty
and does not parse makes the read fail with its column's name and count,
unless the caller asks for NULLs.  Sinks write a directory of part files, one per task; only
the findings frame, a few dozen rows by construction, is coalesced to one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.functions.dates import parse_mixed_date
from churnlens.schemas import REQUIRED_COLUMNS, WIDE_COLUMNS, WIDE_SCHEMA

DATE_COLUMNS = ("join_date", "cancellation_date")
# a record as it stands in a file
WIDE_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in WIDE_COLUMNS])


def require_columns(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Fail before any job if expected columns are absent (the error lists them)."""
    cols = set(df.columns)
    missing = [c for c in (required or REQUIRED_COLUMNS) if c not in cols]
    if missing:
        raise ValueError(f"input lacks the columns {missing}")
    return df


def parsed(name: str, parse_dates: bool) -> Column:
    if name in DATE_COLUMNS:
        return parse_mixed_date(name) if parse_dates else F.col(name)
    return F.col(name).try_cast(WIDE_SCHEMA[name].dataType)


def unparsed(name: str, parse_dates: bool = True) -> Column:
    """The cell is not empty and does not parse."""
    return parsed(name, parse_dates).isNull() & (F.trim(name) != "")


def bad_cells(text: DataFrame, parse_dates: bool = True) -> DataFrame:
    """One row: for each column of the record the number of cells that are not empty and do not parse."""
    return text.agg(*[
        F.count(F.when(unparsed(c, parse_dates), True)).alias(c) for c in WIDE_COLUMNS
    ])


def text_schema(spark: SparkSession, path: str) -> T.StructType:
    """The columns of the first file's header as text; fails where the record's columns are not among them."""
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    require_columns(spark.createDataFrame([], schema), WIDE_COLUMNS)
    return schema


def read_customers_text(spark: SparkSession, path: str) -> DataFrame:
    """The record's columns as text, found by the header's names; further columns are left out."""
    reader = spark.read.schema(text_schema(spark, path)).option("header", True).option("enforceSchema", False)
    return reader.csv(path).select(*WIDE_COLUMNS)


def read_customers_csv(spark: SparkSession, path: str, parse_dates: bool = True, bad: str = "fail") -> DataFrame:
    """Header CSV of wide customer records, columns in any order.

    With ``parse_dates`` the two date columns become DATE; without it they stay
    text, as the raw input of the cleaning operators expects.  A cell that does
    not parse fails the read (``bad="fail"``, one pass over the file that counts
    them) or becomes NULL (``bad="null"``).
    """
    if bad not in ("fail", "null"):
        raise ValueError("bad must be 'fail' or 'null'")
    text = read_customers_text(spark, path)
    if bad == "fail":
        counts = {c: n for c, n in bad_cells(text, parse_dates).first().asDict().items() if n}
        if counts:
            raise ValueError(f"cells that do not parse, by column: {counts}")
    return text.select(*[parsed(c, parse_dates).alias(c) for c in WIDE_COLUMNS])


# Quotes are doubled, blanks kept, empty text is quoted (NULL is not).
CSV_FORM = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV directory (one part file per task)."""
    df.write.mode(mode).options(**CSV_FORM).option("dateFormat", "yyyy-MM-dd").csv(path)


_EMPTY = "\x01empty\x01"  # stands for quoted empty text while a file is parsed


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``write_csv`` wrote.  Texts may hold line ends, so a part file is read by one task."""
    rows = spark.read.schema(schema).options(**CSV_FORM).option("enforceSchema", False).option("multiLine", True) \
        .option("dateFormat", "yyyy-MM-dd").option("emptyValue", _EMPTY).csv(path)
    return rows.select(*[
        F.when(F.col(f"`{f.name}`") == _EMPTY, "").otherwise(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in schema.fields])


def fingerprint(df: DataFrame) -> tuple:
    """Rows and the sums of two hashes of each row: equal for equal rows in any order and layout.

    NULL differs from empty text, and a value's column counts.
    """
    cells = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns]
    hashes = [F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)") for seed in (1, 2)]
    return tuple(df.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(h), F.lit(0)) for h in hashes]).first())


def write_csv_checked(df: DataFrame, path: str) -> DataFrame:
    """``write_csv``, read back and compared by fingerprint; gives the rows as read, fails where they differ."""
    write_csv(df, path)
    back = read_csv(df.sparkSession, path, df.schema)
    written, found = fingerprint(df), fingerprint(back)
    if written != found:
        raise ValueError(f"{path} does not hold what was written: {written[0]} rows became {found[0]}, or cells changed")
    return back


def write_plans_csv(plans: DataFrame, path: str) -> None:
    """The plan lookup (plan_name, price, features)."""
    write_csv(plans.select("plan_name", F.col("price").cast("double").alias("price"), "features"), path)


def findings_lines(findings: DataFrame, generated: Column | None = None) -> DataFrame:
    """The findings frame rendered as report lines, in section order.

    The first line states the generation date (today's unless given) and the number of customers
    (``generated <date> customers <n>``, thousands separated); then one
    tab-separated ``section ord item value`` line per finding.
    """
    generated = F.current_date() if generated is None else generated
    sections = {"key_metrics": 1, "top_drivers": 2, "churn_by_plan": 3, "churn_by_region": 4}
    order = None
    for name, i in sections.items():
        order = F.when(F.col("section") == name, i) if order is None else order.when(F.col("section") == name, i)
    body = findings.select(
        order.otherwise(len(sections) + 1).alias("_s"), F.col("ord").cast("bigint").alias("ord"),
        F.format_string("%s\t%d\t%s\t%s", "section", "ord", "item", F.col("value").cast("string")).alias("value"),
    )
    header = findings.filter((F.col("section") == "key_metrics") & (F.col("item") == "total_customers")).select(
        F.lit(0).alias("_s"), F.lit(0).cast("bigint").alias("ord"),
        F.format_string("generated\t%s\tcustomers\t%s", F.date_format(generated, "yyyy-MM-dd"),
                        F.format_number(F.col("value"), 0)).alias("value"),
    )
    return header.unionByName(body).orderBy("_s", "ord").select("value")


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings report as one text file (the frame is a few dozen rows)."""
    findings_lines(findings).coalesce(1).write.mode("overwrite").text(path)
