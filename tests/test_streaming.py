"""The streaming cleaner equals the batch cleaner on the same files."""

from __future__ import annotations

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from churnlens.operators.cleaning import clean
from churnlens.sources.dirty import make_dirty
from churnlens.streaming.ingest import read_clean_output, read_quarantine, start_clean_stream


def test_stream_matches_batch(spark, small_tables):
    root = tempfile.mkdtemp(prefix="churnlens-stream-")
    src, sink = os.path.join(root, "in"), os.path.join(root, "out")
    dirty = make_dirty(small_tables.wide).withColumn("is_churned", F.col("is_churned").cast("int"))
    # two files: the second repeats some rows of the first (cross-file duplicates)
    first = dirty.filter("customer_id < 100")
    second = dirty.filter("customer_id >= 60")
    first.coalesce(1).write.option("header", True).csv(os.path.join(src, "a"))
    second.coalesce(1).write.option("header", True).csv(os.path.join(src, "b"))
    files = [os.path.join(dp, f) for dp, _, fs in os.walk(src) for f in fs if f.endswith(".csv")]
    flat = os.path.join(root, "flat")
    os.makedirs(flat)
    for i, f in enumerate(sorted(files)):
        os.link(f, os.path.join(flat, f"part{i}.csv"))
    q = start_clean_stream(spark, flat, sink, checkpoint_dir=os.path.join(root, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination(timeout=180)
    streamed = read_clean_output(spark, sink)
    batch = clean(make_dirty(small_tables.wide))
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0
    # the same checkpoint goes on without repeating anything; another one may not write here
    again = start_clean_stream(spark, flat, sink, checkpoint_dir=os.path.join(root, "ckpt"))
    again.awaitTermination(timeout=180)
    assert read_clean_output(spark, sink).count() == batch.count()
    with pytest.raises(ValueError, match="holds batches"):
        start_clean_stream(spark, flat, sink, checkpoint_dir=os.path.join(root, "other"))


@pytest.fixture()
def delivery(spark, small_tables, tmp_path):
    """A folder with good records and three bad ones, in another column order; and the good records."""
    dirty = make_dirty(small_tables.wide).withColumn("is_churned", F.col("is_churned").cast("int"))
    text = dirty.select([F.col(c).cast("string").alias(c) for c in reversed(dirty.columns)])
    bad = text.limit(3).withColumns({
        "customer_id": F.concat(F.lit("9000"), "customer_id"),
        "plan_price": F.lit("9,99"), "join_date": F.lit("soon"), "cancellation_date": F.lit("never")})
    src = str(tmp_path / "in")
    text.unionByName(bad).unionByName(bad).coalesce(1).write.option("header", True).csv(src)
    return src, small_tables.wide


def test_bad_cells_are_set_aside(spark, delivery, tmp_path):
    src, wide = delivery
    sink, aside, ckpt = (str(tmp_path / n) for n in ("out", "aside", "ckpt"))
    start_clean_stream(spark, src, sink, ckpt, quarantine_dir=aside).awaitTermination(timeout=180)
    cleaned, expected = read_clean_output(spark, sink), clean(make_dirty(wide))
    assert cleaned.exceptAll(expected).count() == expected.exceptAll(cleaned).count() == 0
    rows = read_quarantine(spark, aside).collect()
    assert [r.bad for r in rows] == [["plan_price", "join_date"]] * 3  # an unreadable cancellation date is none
    assert all('"plan_price":"9,99"' in r.text and '"customer_id":"9000' in r.text for r in rows)


def test_bad_cells_fail_a_stream_without_quarantine(spark, delivery, tmp_path):
    src, _ = delivery
    sink = str(tmp_path / "out")
    query = start_clean_stream(spark, src, sink, str(tmp_path / "ckpt"))
    with pytest.raises(Exception, match="do not parse"):
        query.awaitTermination(timeout=180)
    assert not os.path.exists(sink)
