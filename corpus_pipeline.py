"""The corpus pipeline: documents through quality, near-dedup, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``.  ``run`` writes each stage's result below
the shared checkpoint folder and reads it again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import decontaminate, mixing, neardup, quality, sharding
from churnlens.llm.common import Scratch, fresh


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    NULL or empty text goes (fewer than 10 words); a NULL language is one of its own;
    equal rows are judged alike and all stay or go; no rows give no rows.
    """
    name = fresh(docs.columns, "quality")
    with Scratch(spark, "quality") as scratch:
        judged = quality.judge(scratch, docs)
    return judged.filter(F.col(f"{name}.kept")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the smallest (id, text).

    Rows without words are in no group and stay; a repeated id loses no other
    text; of rows equal in id and text one stays; rows with a NULL id belong to the group of
    their text and stand for it only where nobody else does.
    """
    with Scratch(spark, "neardup") as scratch:
        groups = neardup.near_duplicates(scratch, docs)
    return neardup.keep_one(docs, groups)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination.

    Documents or items without words are never hit; rows with equal ids are
    judged on their own text; a NULL id is an id like another; without items all stay.
    """
    name = fresh(docs.columns, "hits")
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    with Scratch(spark, "decontaminate") as scratch:
        found = decontaminate.find_hits(scratch, docs, benchmark)
    return found.filter(~F.col(f"{name}.contaminated")).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: no row, one, or up to three equal ones.

    Repeated rows are separate documents; NULL is a source of its own, last; a source without
    words has no target and goes.
    """
    name, copy = fresh(docs.columns, "mix"), fresh(docs.columns, "copy")
    with Scratch(spark, "mix") as scratch:
        mixed = mixing.mix(scratch, docs).filter(F.col(f"{name}.copies") > 0)
    repeated = mixed.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(f"{name}.copies"))))
    return repeated.select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot, in new columns ``shard_number`` and ``shard_slot`` (or free names).

    Every row keeps its place, repeated and empty ones too; NULL ids come last within a cell.
    """
    name = fresh(docs.columns, "shard")
    with Scratch(spark, "shard") as scratch:
        cut = sharding.shard(scratch, docs)
    number, slot = fresh(docs.columns, "shard_number"), fresh(docs.columns, "shard_slot")
    return cut.select(*docs.columns, F.col(f"{name}.shard").alias(number), F.col(f"{name}.slot").alias(slot))


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", shards),
]

#: Near-duplicate groups of the second stage are a fixed point over confirmed
#: links; the chain is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.publish(stage(spark, docs, sf_dir), name)
    return docs
