"""Gapless numbers for distributed rows, in a stated order.

One range shuffle sorts the slim rows; every task's range is counted, the
counts' prefix sums give each range its first number, and rows are numbered
within their range.  No task holds more than a range, and no window spans all
rows.  The sorted rows are written before they are counted, so a lost executor
recomputes from files and both passes see the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Stage = Callable[[DataFrame, str], DataFrame]


def gapless(df: DataFrame, order: list[Column], numbers: dict[str, tuple[Column, int]], stage: Stage) -> DataFrame:
    """``df`` with a column for each of ``numbers``: name -> (condition, highest number given so far).

    Rows whose condition is TRUE get the numbers after the highest one, without
    gaps, in the order ``order``; the others get NULL.  Rows equal in the whole
    order are numbered as they fall.
    """
    flags = {f"_takes_{k}": F.coalesce(cond, F.lit(False)).cast("int") for k, (cond, _) in numbers.items()}
    ranged = df.select("*", *[c.alias(k) for k, c in flags.items()]) \
        .repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    # the upper bits of the id are the task's number, the lower ones count its rows
    ranged = stage(ranged, "ranged").withColumn("_range", F.shiftright("_place", 33))
    counts = ranged.groupBy("_range").agg(*[F.sum(k).alias(f"_n{k}") for k in flags])
    ranges_before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    before = stage(counts.select(F.col("_range").alias("_of"), *[
        F.coalesce(F.sum(f"_n{k}").over(ranges_before), F.lit(0)).alias(f"_before{k}") for k in flags]), "ranges")
    so_far = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(before, F.col("_range") == F.col("_of"))
    out = {k: F.when(F.col(f"_takes_{k}") == 1, F.col(f"_before_takes_{k}") + F.sum(f"_takes_{k}").over(so_far) + high)
           for k, (_, high) in numbers.items()}
    return placed.select(*df.columns, *[c.cast("bigint").alias(k) for k, c in out.items()])
