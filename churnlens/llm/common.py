"""Helpers shared by the corpus operators: words, scratch tables, global order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import checkpoint_root

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character unchanged (NULL stays NULL)."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def count_words(text: Column) -> Column:
    """Number of runs of non-space characters; NULL counts as empty."""
    trimmed = strip_space(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE + "+"))).cast("bigint")


def fresh(taken: list[str], name: str) -> str:
    """``name``, or ``name_1``, ``name_2`` ... if the frame already has such a column (case-blind)."""
    seen = {c.lower() for c in taken}
    out, n = name, 0
    while out.lower() in seen:
        n += 1
        out = f"{name}_{n}"
    return out


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables below the shared checkpoint folder: written once, read by later steps.

    A written table cuts the lineage: a lost executor re-reads files that all
    executors share.  Everything written with ``table`` is deleted on exit;
    ``publish`` writes a result that outlives the block and is deleted when the
    application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self._spark = spark
        self._base = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        self.drop("")

    def path(self, name: str) -> str:
        return f"{self._base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        fs, p = _hadoop_path(self._spark, self.path(name) if name else self._base)
        fs.delete(p, True)

    def publish(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self._base}-{name}"
        df.write.parquet(path)
        fs, p = _hadoop_path(self._spark, path)
        fs.deleteOnExit(p)
        return self._spark.read.schema(df.schema).parquet(path)


def global_positions(scratch: Scratch, df: DataFrame, order: list[Column], name: str, position: str) -> DataFrame:
    """Rows of ``df`` with their 0-based position in the total order ``order``.

    One range shuffle; each task sorts its own range and numbers its rows, the
    ranges' row counts (one number a task) give each range's first position.
    No task holds more than its range, whatever key is hot.  The numbered rows
    are published before the counts are taken, so both read the same ranges.
    Rows equal in all of ``order`` are spread over ranges as they fall.
    """
    mid, block = fresh(df.columns, "mid"), fresh(df.columns, "block")
    tie = fresh(df.columns, "tie")
    keyed = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(*order, F.col(tie)).sortWithinPartitions(*order, F.col(tie))
    numbered = ranged.drop(tie).withColumn(mid, F.monotonically_increasing_id())
    table = scratch.publish(numbered, name)
    table = table.withColumn(block, F.shiftright(mid, 33)).withColumn(mid, F.col(mid).bitwiseAND((1 << 33) - 1))
    counts = table.groupBy(block).agg(F.count(F.lit(1)).alias("n_rows"))
    first = counts.select(block, F.expr(
        f"coalesce(sum(n_rows) OVER (ORDER BY {block} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    ).alias(position))
    first = scratch.publish(first, f"{name}_first")
    return table.join(first, block).withColumn(position, F.col(position) + F.col(mid)).drop(block, mid)
