"""Incremental cleaning of customer-record files with Structured Streaming.

New CSV files landing in a folder are cleaned exactly as the batch pipeline
cleans one file: exact-row dedup first (across *all* files seen so far, held
in the streaming state store and keyed by the full row), then the row-local
normalisation steps.  Cells that do not parse fail the stream or set their
record aside in a quarantine folder, by the rules of the batch reader.  Each micro-batch is written by ``foreachBatch`` into its
own ``batch_id=<n>`` folder with overwrite, so a replayed batch after a failure
rewrites the same output instead of duplicating it (exactly-once output).

The dedup state grows with the number of distinct rows (exact dedup over all
time); on a cluster use the RocksDB state store provider
(``spark.sql.streaming.stateStore.providerClass``) so it spills to local disk
and is checkpointed.  A checkpoint belongs to one sink: a stream that starts
afresh refuses a sink that already holds batches, since it would number its
own from 0 again and overwrite them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from churnlens.operators.cleaning import normalise
from churnlens.schemas import WIDE_COLUMNS
from churnlens.session import hadoop_path
from churnlens.sources.files import DATE_COLUMNS, WIDE_TEXT, parsed, text_schema, unparsed


def read_raw_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw records of the files in ``source_dir`` as the batch reader gives them, with what did not parse.

    Columns are read as text; ``bad`` names those whose cell is not empty and does not
    parse (an unparseable cancellation date is none: cleaning makes it NULL), ``text``
    holds the record as it came where there are any.  Files whose header differs fail.
    """
    names = text_schema(spark, source_dir) if _matches(spark, f"{source_dir}/*") else WIDE_TEXT
    reader = spark.readStream.schema(names).option("header", True).option("enforceSchema", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    text = reader.csv(source_dir).select(*WIDE_COLUMNS)
    bad = F.array_compact(F.array(*[F.when(unparsed(c, c != "cancellation_date" and c in DATE_COLUMNS), F.lit(c))
                                    for c in WIDE_COLUMNS]))
    return text.select(*[parsed(c, parse_dates=False).alias(c) for c in WIDE_COLUMNS], bad.alias("bad"),
                       F.when(F.size(bad) > 0, F.to_json(F.struct(*WIDE_COLUMNS))).alias("text"))


def _matches(spark: SparkSession, pattern: str) -> bool:
    fs, path = hadoop_path(spark, pattern)
    found = fs.globStatus(path)
    return found is not None and len(found) > 0


def start_clean_stream(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    quarantine_dir: str | None = None,
) -> StreamingQuery:
    """Start the cleaning stream; returns the running query.

    Records with bad cells go to ``quarantine_dir``, with the names of the
    columns and the record as it came; without such a folder the stream fails
    on them before it writes the batch, as the batch reader does.
    """
    if _matches(spark, f"{sink_dir}/batch_id=*") and not _matches(spark, f"{checkpoint_dir}/offsets/*"):
        raise ValueError(f"{sink_dir} holds batches that are not from the checkpoint {checkpoint_dir}")
    # good records are compared by value, bad ones as they came
    deduped = read_raw_stream(spark, source_dir, max_files_per_trigger).dropDuplicates([*WIDE_COLUMNS, "text"])

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read up to three times; recomputed from the source where blocks are lost
        try:
            bad = batch.filter(F.size("bad") > 0).select("bad", "text")
            if quarantine_dir:
                bad.write.mode("overwrite").json(os.path.join(quarantine_dir, f"batch_id={batch_id}"))
            else:
                counts = bad.select(F.explode("bad").alias("column")).groupBy("column").count().collect()  # a row a column
                if counts:
                    raise ValueError(f"cells that do not parse, by column: {dict(map(tuple, counts))}")
            cleaned = normalise(batch.filter(F.size("bad") == 0).select(*WIDE_COLUMNS)).select(*WIDE_COLUMNS)
            cleaned.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={batch_id}"))
        finally:
            batch.unpersist()

    writer = deduped.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_clean_output(spark: SparkSession, sink_dir: str) -> DataFrame:
    """All cleaned rows written so far (the batch folder is a partition column, dropped)."""
    return spark.read.parquet(sink_dir).select(*WIDE_COLUMNS)


def read_quarantine(spark: SparkSession, quarantine_dir: str) -> DataFrame:
    """(bad, text) of all records set aside so far."""
    return spark.read.schema("bad array<string>, text string").json(quarantine_dir)
