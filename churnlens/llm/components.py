"""Connected components of a link table by alternating star contractions.

Each round joins every node's neighbours to its smallest one: first the larger
neighbours (large star), then the smaller ones (small star).  The tables of
the rounds are written to the shared folder; a fixed point is a forest of
stars around the smallest node of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import Scratch


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(hi, lo) for each linked node other than its component's smallest: ``lo`` is that node.

    ``links`` has two long columns ``a`` and ``b``; order and repeats don't matter.
    """
    start = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = scratch.table(start, f"{name}_0")
    seen = _fingerprint(edges)
    turn = 0
    while seen[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # written before the join: Spark splits a hot node's rows only where both sides are plain shuffles
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = scratch.table(least, f"{name}_least_{turn}")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = scratch.table(large, f"{name}_large_{turn}")
        lowest = scratch.table(large.groupBy("hi").agg(F.min("lo").alias("m")), f"{name}_lowest_{turn}")
        small = large.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")) \
            .union(lowest.select("hi", F.col("m").alias("lo"))).distinct()
        turn += 1
        edges = scratch.table(small, f"{name}_{turn}")
        now = _fingerprint(edges)
        scratch.drop(f"{name}_{turn - 1}")
        if now == seen:
            break
        seen = now
    return edges
