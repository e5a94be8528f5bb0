"""Long repeated spans removed by compacted k-mer paths.

The graph: every run of ``window`` words is an edge between its first and last
``window - 1`` words.  A shared passage is a path of shared edges, and most of
it does not branch, so edges are compacted before anything is shuffled:
consecutive edges with the same anchor (the leftmost smallest hash among their
``ANCHOR``-word runs) form one path segment.  Anchors depend on the edge's own
words only, so equal edges have equal anchors, and inside a shared passage the
segments are equal as wholes.

1. segments of all documents: about one row for 18 words;
2. segments whose anchor lies in one document only share nothing and drop out;
3. equal segments are joined at once, each to its source, the place in the smallest
   document that holds it;
4. the segments left branch (the passage ends inside them, or an edit does):
   only these are unfolded into single edges at their source coordinates, and
   the edges joined the same way;
5. pieces that follow each other in a document and in their source are one path and compact to
   one span with its source coordinates;
6. the span's words and those at its source coordinates are read again from the texts and compared by
   SHA-256; a span that differs (a collision of the hashes above) removes nothing;
7. each document's spans remove its words.

Segments and edges are proposed by 64 to 128 bits of hash (the anchor's and an
independent one of all the words between their coordinates), the verdict is the
comparison of step 6.  Counts are
pre-aggregated, joins are equi-joins that Spark may split, and a hot passage
costs one row for each place it occurs in.

Words are runs of characters other than the six ASCII spaces, unchanged.
Defined results: NULL or empty text has no words; rows with equal ids are one
document (they don't remove each other's words); NULL ids are one document,
larger than all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from churnlens.llm.common import Scratch, fresh
from churnlens.llm.hashing import WindowHasher, word_hashes

WINDOW = 50
ANCHOR = 16
LAST_ID = 2 ** 63 - 1  # stands for a NULL id


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in each run of ``width`` values."""
    best = np.arange(len(values))
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        covered += step
    return best


def segments(hashes: np.ndarray, hasher: WindowHasher, window: int, anchor: int) -> tuple:
    """(anchor hash, segment hash, first edge, last edge) of a document's segments."""
    width = min(anchor, window)
    grams = hasher.windows(hashes, width, 0)
    at = sliding_argmin(grams, window - width + 1)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    body = hasher.spans(hasher.prefixes(hashes, 1), first, last + window, 1)
    return grams[at[first]], body, first, last


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_SEGMENTS = pa.schema([("anchor", pa.int64()), ("body", pa.int64()), ("id", pa.int64()), ("rid", pa.int64()),
                       ("first", pa.int32()), ("n_edges", pa.int32())])
_EDGES = pa.schema([("anchor", pa.int64()), ("body", pa.int64()), ("id", pa.int64()), ("rid", pa.int64()),
                    ("first", pa.int32())])
_ROWS = 100_000


def _find_segments(window: int, anchor: int, hash_words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHasher()
        parts: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[]] * 6
            parts.clear()
            return _batch(columns, _SEGMENTS)

        for batch in batches:
            for i, rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                if len(words) < window:
                    continue
                key, body, first, last = segments(hash_words(words), hasher, window, anchor)
                parts.append((key.view(np.int64), body.view(np.int64), np.full(len(first), i), np.full(len(first), rid),
                              first.astype(np.int32), (last - first + 1).astype(np.int32)))
                held += len(first)
                if held > _ROWS:
                    yield flush()
                    held = 0
        yield flush()
    return run


def _unfold(window: int, hash_words):
    """Single edges of the segments listed with each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHasher()
        for batch in batches:
            for i, rid, text, listed in zip(*(batch.column(c) for c in ("id", "rid", "text", "listed"))):
                hashes = hash_words((text.as_py() or "").encode().split())
                prefixes = hasher.prefixes(hashes, 1)
                flat = listed.values
                key, first, count = (flat.field(k).to_numpy() for k in range(3))
                for begin in range(0, len(key), 5000):
                    c = count[begin: begin + 5000]
                    ends = np.cumsum(c)
                    at = np.repeat(first[begin: begin + 5000] - (ends - c), c) + np.arange(ends[-1])
                    body = hasher.spans(prefixes, at, at + window, 1)
                    n = len(at)
                    yield _batch([np.repeat(key[begin: begin + 5000], c), body.view(np.int64),
                                  np.full(n, i.as_py()), np.full(n, rid.as_py()), at.astype(np.int32)], _EDGES)
    return run


_DIGESTS = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])


def _digest_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the listed word spans of each text."""
    for batch in batches:
        for i, rid, text, listed in zip(*(batch.column(c) for c in ("id", "rid", "text", "listed"))):
            words = (text.as_py() or "").encode().split()
            start, n = (listed.values.field(k).to_numpy() for k in range(2))
            digests = [hashlib.sha256(b" ".join(words[a: a + m])).digest() for a, m in zip(start.tolist(), n.tolist())]
            yield _batch([np.full(len(n), i.as_py()), np.full(len(n), rid.as_py()), start, n, digests], _DIGESTS)


_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("kept_text", T.StringType()),
])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("kept_text", pa.string())]
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            part = batch.slice(begin, 1000)
            total, removed, kept = [], [], []
            for text, spans in zip(part.column("text"), part.column("spans")):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                total.append(n)
                if spans.is_valid and len(spans):
                    edges = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edges, spans.values.field(0).to_numpy(), 1)
                    np.add.at(edges, spans.values.field(1).to_numpy(), -1)
                    gone = np.cumsum(edges[:n]) > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            result = pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip((total, removed, kept), fields)], fields=fields)
            yield pa.RecordBatch.from_arrays([part.column("row"), result], ["row", "result"])


def _paths(pieces: DataFrame, window: int) -> DataFrame:
    """(id, rid, start, n, source_id, source_rid, source_start): pieces that continue each other, as one span of words.

    A piece continues another if it begins among its edges or right behind them, in
    the document and in the source alike.
    """
    shifted = pieces.select(
        "id", "rid", F.col("source.id").alias("source_id"), F.col("source.rid").alias("source_rid"),
        (F.col("first") - F.col("source.first")).alias("shift"), "first", (F.col("first") + F.col("n_edges")).alias("behind")).distinct()
    path = ["id", "rid", "source_id", "source_rid", "shift"]  # no more pieces than the document has
    along = Window.partitionBy(*path).orderBy("first", "behind")
    reached = F.max("behind").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached.isNull() | (F.col("first") > reached), 1).otherwise(0)
    numbered = shifted.withColumn("begins", begins).withColumn("number", F.sum("begins").over(
        along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = numbered.groupBy(*path, "number").agg(F.min("first").alias("start"), F.max("behind").alias("behind"))
    return whole.select("id", "rid", "start", (F.col("behind") - F.col("start") + (window - 1)).cast("int").alias("n"),
                        "source_id", "source_rid", (F.col("start") - F.col("shift")).cast("int").alias("source_start"))


def _verified(scratch: Scratch, rows: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths whose words equal those at their source."""
    here = paths.select("id", "rid", "start", "n")
    there = paths.select(F.col("source_id").alias("id"), F.col("source_rid").alias("rid"), F.col("source_start").alias("start"), "n")
    listed = here.union(there).groupBy(F.col("id").alias("listed_id"), F.col("rid").alias("listed_rid")) \
        .agg(F.collect_set(F.struct("start", "n")).alias("listed"))
    texts = rows.select("id", "rid", "text").join(
        scratch.table(listed, "listed_spans"), (F.col("id") == F.col("listed_id")) & (F.col("rid") == F.col("listed_rid")))
    digests = texts.select("id", "rid", "text", "listed").mapInArrow(
        _digest_spans, "id long, rid long, start int, n int, digest binary")
    digests = scratch.table(digests.distinct(), "digests")
    own = scratch.table(paths.join(digests, ["id", "rid", "start", "n"]), "own_digests")
    source = digests.select(F.col("id").alias("source_id"), F.col("rid").alias("source_rid"), F.col("start").alias("source_start"), "n",
                            F.col("digest").alias("source_digest"))
    return own.join(source, ["source_id", "source_rid", "source_start", "n"]).filter("digest = source_digest") \
        .select("id", "rid", "start", "n")


def remove_repeats(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, anchor: int = ANCHOR, carry: list[str] | None = None,
                   hash_words: Callable[[list[bytes]], np.ndarray] = word_hashes) -> DataFrame:
    """Rows of ``docs`` with n_words, n_removed and the kept text, in the struct ``repeats`` (or a free name).

    Tables still needed by the result are published, the others belong to ``scratch``.
    ``carry`` lists the columns kept (all by default).
    """
    carry = list(docs.columns) if carry is None else carry
    name = fresh(docs.columns, "repeats")
    text = F.col(f"`{text_col}`")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), ident.alias("id"),
                       F.xxhash64(ident, F.coalesce(text, F.lit(""))).alias("rid"), text.alias("text"))

    found = scratch.table(rows.select("id", "rid", "text").mapInArrow(
        _find_segments(window, anchor, hash_words), "anchor long, body long, id long, rid long, first int, n_edges int"), "found")
    in_two = found.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")) \
        .filter("lo < hi").select("anchor")
    shared = scratch.table(found.join(in_two, "anchor", "left_semi"), "shared")
    scratch.drop("found")

    place = F.struct("id", "rid", "first")
    sources = shared.groupBy("anchor", "body").agg(F.min(place).alias("source"))
    placed = scratch.publish(shared.join(sources, ["anchor", "body"])
                             .withColumn("repeated", F.col("id") > F.col("source.id")), "placed")
    branching = placed.filter("NOT repeated")
    open_anchors = branching.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")) \
        .filter("lo < hi").select("anchor")
    listed = branching.join(open_anchors, "anchor", "left_semi").groupBy(F.col("id").alias("listed_id"), F.col("rid").alias("listed_rid")) \
        .agg(F.collect_set(F.struct("anchor", "first", "n_edges")).alias("listed"))
    listed = scratch.publish(listed, "listed")
    edges = rows.join(listed, (F.col("id") == F.col("listed_id")) & (F.col("rid") == F.col("listed_rid"))).select("row", "id", "rid", "text", "listed") \
        .mapInArrow(_unfold(window, hash_words), "anchor long, body long, id long, rid long, first int")
    edges = scratch.table(edges, "edges")
    edge_sources = edges.groupBy("anchor", "body").agg(F.min(place).alias("source"))
    repeated_edges = edges.join(edge_sources, ["anchor", "body"]).filter("id > source.id")

    pieces = placed.filter("repeated").select("id", "rid", "source", "first", "n_edges") \
        .union(repeated_edges.select("id", "rid", "source", "first", F.lit(1).alias("n_edges")))
    paths = scratch.table(_paths(pieces, window), "paths")
    spans = _verified(scratch, rows, paths).groupBy(F.col("id").alias("spans_id"), F.col("rid").alias("spans_rid")) \
        .agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))).alias("spans"))
    spans = scratch.publish(spans, "spans")
    joined = rows.join(spans, (F.col("id") == F.col("spans_id")) & (F.col("rid") == F.col("spans_rid")), "left") \
        .select("row", "text", "spans")
    schema = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("result", _RESULT)])
    return joined.mapInArrow(_remove, schema).select("row.*", F.col("result").alias(name))
