"""Quality rules by distribution divergence from language references.

Reference of a language: the byte-class histogram of all its documents and the
frequencies of its ``top_words`` most common words (the rest is one bin).  A
document is compared with its language's reference by Jensen-Shannon distance
(base 2, 0 to 1); it fails if the class distance exceeds ``max_class`` or the
word distance exceeds ``max_word``.  Guards: documents under ``min_words``
words are not judged by words, those under ``min_chars`` bytes not by classes,
and a language with fewer than ``min_reference`` words judges nobody.

Base rules fail documents of fewer than 10 words, and those with more than a
fifth of their words in 5-word windows that occur twice or more in the text.

Words are runs of characters other than the six ASCII spaces.  Two passes over
the texts; the first returns word counts merged in the task (flushed at
``FLUSH`` distinct words, so memory is bounded), the second is joined with one
reference row a language, whose known size lets Spark choose the join.

Defined results: NULL and empty text have no words and fail the base rules;
NULL language is a language of its own; repeated rows are judged alike; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from churnlens.llm.common import Scratch, fresh

TOP_WORDS = 64
MIN_WORDS = 60
MIN_CHARS = 400
MIN_REFERENCE = 2000
MAX_CLASS = 0.3
MAX_WORD = 0.5
FLUSH = 200_000
SPAN = 5

# byte classes: space, lower, upper, digit, sentence punctuation, symbols, other ASCII, lead byte, continuation
N_CLASSES = 9
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 5
_CLASS[0xC0:] = 7
_CLASS[0x80:0xC0] = 8

METRICS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("class_distance", T.DoubleType()),
    T.StructField("word_distance", T.DoubleType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
])


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=N_CLASSES)


def repeated_words(words: list[bytes], span: int = SPAN) -> int:
    """Words covered by windows of ``span`` words that occur twice or more."""
    n = len(words)
    if n <= span:
        return 0
    ids: dict[bytes, int] = {}
    ranks = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    window = ranks
    for width in range(1, span):  # rank of a window of width + 1 words from that of width and the next word
        pair = window[: n - width] * np.int64(len(ids)) + ranks[width:]
        window, counts = np.unique(pair, return_inverse=True, return_counts=True)[1:]
        if counts.max() < 2:
            return 0
    starts = np.flatnonzero(counts[window] > 1)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + span, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def base_metrics(text: str | None) -> tuple[list[bytes], np.ndarray, int, int, int]:
    """(words, class counts, code points in words, repeated lines, repeated words)"""
    data = (text or "").encode()
    words = data.split()
    classes = class_counts(data)
    word_chars = int(classes.sum() - classes[0] - classes[8])
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    return words, classes, word_chars, dup, repeated_words(words)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2) of two histograms; 0 if either is empty."""
    if p.sum() == 0 or q.sum() == 0:
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (left + right) / 2)))


_COUNT_SCHEMA = "lang string, kind int, word binary, n bigint"


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str | None, Counter] = {}
    classes: dict[str | None, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, 0, w, n) for lang, c in words.items() for w, n in c.items()]
        for lang, c in classes.items():
            rows += [(lang, 1, bytes([i]), int(n)) for i, n in enumerate(c)]
        words.clear()
        classes.clear()
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([
            pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()),
            pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())], ["lang", "kind", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = (text or "").encode()
            words.setdefault(lang, Counter()).update(data.lower().split())
            classes[lang] = classes.get(lang, 0) + class_counts(data)
            if sum(map(len, words.values())) > FLUSH:
                yield flush()
    yield flush()


def language_references(scratch: Scratch, docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                        top_words: int = TOP_WORDS) -> DataFrame:
    """(lang, n_words, common: array of (word, n), classes: array of counts), one row a language."""
    slim = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counts = slim.mapInArrow(_count_batches, _COUNT_SCHEMA) \
        .groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    counts = scratch.table(counts, "counts")  # read twice below
    # the totals and the classes need no ranking; the ranking keeps top_words rows a task and language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("word")))
    common = counts.filter("kind = 0").withColumn("place", place).filter(F.col("place") <= top_words) \
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("common"))
    totals = counts.groupBy("lang").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.struct("word", "n")))).alias("classes"))
    return totals.join(common.withColumnRenamed("lang", "common_lang"),
                       F.col("lang").eqNullSafe(F.col("common_lang")), "left") \
        .select(F.col("lang").alias("ref_lang"), F.coalesce("n_words", F.lit(0)).alias("ref_words"),
                F.col("common.word").alias("ref_common"), F.col("common.n").alias("ref_counts"),
                F.col("classes.n").alias("ref_classes"))


def _judge(limits: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references: dict = {}
        metric_type = pa.struct([
            ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
            ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
            ("class_distance", pa.float64()), ("word_distance", pa.float64()),
            ("base_failed", pa.bool_()), ("kept", pa.bool_())])
        for batch in batches:
            rows = []
            text, lang = batch.column("text"), batch.column("ref_lang").to_pylist()
            for i in range(batch.num_rows):
                if lang[i] not in references:
                    ref_words, common, counts, classes = (
                        batch.column(c)[i].as_py() for c in ("ref_words", "ref_common", "ref_counts", "ref_classes"))
                    common, counts = common or [], counts or []
                    references[lang[i]] = (
                        ref_words or 0, {w: k for k, w in enumerate(common)},
                        np.array([*counts, max(0, (ref_words or 0) - sum(counts))], dtype=float),
                        np.array(classes or [0] * N_CLASSES, dtype=float))
                total, places, word_ref, class_ref = references[lang[i]]
                words, classes, word_chars, dup, repeats = base_metrics(text[i].as_py())
                n = len(words)
                failed = n < 10 or 100 * repeats > 20 * n
                class_distance = word_distance = None
                if total >= limits["min_reference"]:
                    if classes.sum() >= limits["min_chars"]:
                        class_distance = jensen_shannon(classes, class_ref)
                    if n >= limits["min_words"]:
                        rest = len(places)
                        own = np.bincount([places.get(w.lower(), rest) for w in words], minlength=rest + 1)
                        word_distance = jensen_shannon(own, word_ref)
                kept = not (failed or (class_distance or 0.0) > limits["max_class"]
                            or (word_distance or 0.0) > limits["max_word"])
                rows.append((n, word_chars, int(classes[5]), dup, repeats, class_distance, word_distance, failed, kept))
            metrics = pa.StructArray.from_arrays(
                [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(metric_type)], fields=list(metric_type))
            yield pa.RecordBatch.from_arrays([batch.column("row"), metrics], ["row", "metrics"])
    return run


def judge(scratch: Scratch, docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          carry: list[str] | None = None, **limits) -> DataFrame:
    """Rows of ``docs`` with the struct ``quality`` (or a free name) of METRICS.

    ``carry`` lists the columns kept (all by default); ``limits`` overrides
    top_words, min_words, min_chars, min_reference, max_class and max_word.
    """
    limit = {"top_words": TOP_WORDS, "min_words": MIN_WORDS, "min_chars": MIN_CHARS, "min_reference": MIN_REFERENCE,
             "max_class": MAX_CLASS, "max_word": MAX_WORD} | limits
    carry = list(docs.columns) if carry is None else carry
    name = fresh(docs.columns, "quality")
    references = scratch.publish(language_references(scratch, docs, text_col, lang_col, limit["top_words"]), "references")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                       F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    joined = rows.join(references, F.col("lang").eqNullSafe(F.col("ref_lang"))) \
        .select("row", "text", "ref_lang", "ref_words", "ref_common", "ref_counts", "ref_classes")
    schema = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("metrics", METRICS)])
    return joined.mapInArrow(_judge(limit), schema).select("row.*", F.col("metrics").alias(name))
