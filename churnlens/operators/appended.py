"""Keys of appended records against the loaded tables, without shuffling these.

The loaded records are bucketed by customer id, so a lookup by id moves only the
ids of the new records into the buckets' layout; of the loaded table the id
column is scanned where it lies.  New ids are reduced to one row each first, so an
id with a third of the new rows is one lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.audit import NO_CUSTOMER, REPEATED_ID
from churnlens.plans.tables import ChurnTables


def id_counts(loaded: ChurnTables, new: DataFrame) -> DataFrame:
    """For each id that the new rows name: (customer_id, customers, subscriptions, usage_metrics, is_loaded).

    ``new`` is an intake (``operators.audit``); the counts are of its rows of each relation.
    """
    named = new.select(F.inline(F.array(*[
        F.struct(F.col(f"{r}.customer_id").alias("customer_id"), F.lit(r).alias("relation"))
        for r in ("customers", *NO_CUSTOMER)]))).filter("customer_id IS NOT NULL")
    counts = named.groupBy("customer_id").agg(*[
        F.count(F.when(F.col("relation") == r, 1)).alias(r) for r in ("customers", *NO_CUSTOMER)])
    if loaded.buckets:  # into the buckets' own layout; otherwise Spark may move the larger side
        counts = counts.repartition(loaded.buckets, "customer_id")
    known = loaded.records.select(F.col("customer_id").alias("_loaded"))
    # the loaded side keeps its buckets: a merge join, whatever the sizes
    found = counts.join(known.hint("merge"), F.col("customer_id") == F.col("_loaded"), "left")
    return found.withColumn("is_loaded", F.col("_loaded").isNotNull()).drop("_loaded")


def check_appended(loaded: ChurnTables, new: DataFrame) -> DataFrame:
    """K1 and K6 as they would read after appending: ids then held twice, references then without a parent.

    Equal to the full checks over old and new rows together, given that the
    loaded tables break neither.
    """
    counts = id_counts(loaded, new)
    repeated = (F.col("customers") > 1) | ((F.col("customers") > 0) & F.col("is_loaded"))
    orphan = (F.col("customers") == 0) & ~F.col("is_loaded")
    one = counts.agg(F.count(F.when(repeated, 1)).alias("repeated"), *[
        F.coalesce(F.sum(F.when(orphan, F.col(r))), F.lit(0)).alias(r) for r in NO_CUSTOMER])
    return one.select(F.inline(F.array(
        F.struct(F.lit(REPEATED_ID).alias("constraint_name"), F.col("repeated").alias("violations")),
        *[F.struct(F.lit(name).alias("constraint_name"), F.col(r).alias("violations")) for r, name in NO_CUSTOMER.items()])))
