"""Line dedup: repeated lines stay in the smallest document that holds them.

Lines become slim rows (hash of the key, document, position), which are
range-partitioned by hash with document and position as secondary sort: a hot
line's rows spread over many ranges, in order.  Each range streams its runs of
equal hashes and keeps the run's first document; a run that a range boundary
cuts gets the first document of its earlier part from a summary of two rows a
range.  The result is a bitmap for each document in words of 64 lines, where
words without a dropped line are left out; the text itself is not moved by
this step.

Keys: the line without spaces at both ends, A-Z lower-cased; keys under
``min_chars`` code points never repeat.  Hashes are MD5 (128 bits).

Defined results: NULL or empty text is one empty line; rows with equal ids are
one document for the rule, each row keeps its own bitmap; NULL ids are one
document, larger than all others; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.llm.common import Scratch, fresh, lower_ascii, strip_space

MIN_CHARS = 10


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _row_key(id_col: Column, text: Column) -> list[Column]:
    """Identity of a row: its id and its text's digest (equal rows share a bitmap)."""
    return [id_col.alias("id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest")]


def drop_bitmaps(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, digest, n_dropped, words): one row for each document with a dropped line.

    ``words`` is a map from word number (position div 64) to the 64 bits of
    that word, a set bit being a dropped line.
    """
    text = F.col(f"`{text_col}`")
    lines = docs.select(*_row_key(F.col(f"`{id_col}`"), text), F.posexplode(line_array(text)).alias("pos", "line"))
    keyed = lines.select("id", "digest", "pos", lower_ascii(strip_space(F.col("line"))).alias("key")) \
        .filter(F.char_length("key") >= min_chars)
    slim = keyed.select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash"), "id", "digest", "pos")
    # written before the range shuffle, which reads its input twice
    rows = scratch.table(slim, "slim_rows") \
        .repartitionByRange("hash", F.col("id").asc_nulls_last(), "digest", "pos") \
        .sortWithinPartitions("hash", F.col("id").asc_nulls_last(), "digest", "pos") \
        .withColumn("block", F.spark_partition_id())
    rows = scratch.table(rows, "line_rows")

    run = Window.partitionBy("block", "hash").orderBy(F.col("id").asc_nulls_last())
    runs = rows.withColumn("first_id", F.first("id").over(run))
    # the runs at the ends of a range: at most two rows a range
    ends = rows.groupBy("block").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    cut = ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("hash")) \
        .groupBy("hash").agg(F.count(F.lit(1)).alias("n_ranges")).filter("n_ranges > 1").select("hash")
    cut = scratch.table(cut, "cut_hashes")  # its known size keeps the hot line's rows where they are
    carried = rows.join(cut, "hash").groupBy("hash").agg(F.min("id").alias("carried_id"))
    carried = scratch.table(carried, "cut_runs")
    dropped = runs.join(carried, "hash", "left") \
        .withColumn("first_id", F.coalesce("carried_id", "first_id")) \
        .filter("first_id IS NOT NULL AND NOT (id <=> first_id)")
    words = dropped.groupBy("id", "digest", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    bitmaps = words.groupBy("id", "digest").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return scratch.publish(bitmaps, "bitmaps")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped and the kept text, in the struct ``lines`` (or a free name)."""
    name = fresh(docs.columns, "lines")
    text = F.col(f"`{text_col}`")
    marks = bitmaps.select(F.col("id").alias("mark_id"), F.col("digest").alias("mark_digest"), "n_dropped", "words")
    key = _row_key(F.col(f"`{id_col}`"), text)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key, text.alias("text"))
    joined = keyed.join(marks, F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("digest") == F.col("mark_digest")),
                        "left")
    every = line_array(F.col("text"))
    kept = F.filter(every, lambda line, i: F.getbit(
        F.coalesce(F.try_element_at(F.col("words"), F.floor(i / 64).cast("int")), F.lit(0).cast("bigint")),
        i % 64) == 0)
    return joined.select("row.*", F.struct(
        F.size(every).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
        F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(
            F.array_join(kept, "\n")).alias("kept_text")).alias(name))
