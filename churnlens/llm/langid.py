"""Language identification by unigram piece models, marginalised over all segmentations.

The pieces are the ordinary pieces of a public vocabulary file (``VOCABULARY``,
a SentencePiece model; nothing is trained but the probabilities).  A language
has a probability for each piece; the probability of a word is the sum, over
all its segmentations into pieces, of the product of their probabilities,
computed by a forward pass over the word's characters.  Words are runs of
letters, lower-cased, with the vocabulary's word mark in front; a character
that is no piece counts as the unknown piece.

1. Training: words of all labelled texts are counted by language (one shuffle
   of partial counts).  ``ROUNDS`` rounds of expectation maximisation: each task runs
   forward and backward over its distinct words and adds up the expected
   piece counts; these are summed by (language, piece).  The model has at
   most vocabulary x languages values, whatever the corpus' size, and that is what is
   broadcast.  Every language has the same ``SMOOTHING`` added to each piece's count.
2. Prediction: a text's score for a language is the log prior plus the sum over its
   words of their log probabilities; ``score`` is the best language's share
   after the softmax, rounded to 6 digits.  Word values are kept in a table of at
   most ``CACHED`` words a task, which only saves time.

Words of more than ``LONG`` characters take passes of their own with
rescaling; no probability is below ``LEAST``, so that shorter ones cannot underflow.
Defined results: NULL text, or text without a letter, is ``und`` with score 0; so
is every text where nothing was learned; ties go to the smaller language; NULL
languages teach nothing; equal rows get equal results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.llm.common import Scratch, fresh

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS = 2
SMOOTHING = 0.1
PIECE_CHARS = 16
LONG = 24
LEAST = 1e-11
CACHED = 200_000
MARK = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """Lower-cased ordinary pieces of a SentencePiece model, distinct and sorted; the unknown piece is the empty string."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(k).lower() for k in range(model.get_piece_size())
              if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))}
    return ["", *sorted(p for p in pieces if p and len(p) <= PIECE_CHARS)]


def text_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    found = _LETTERS.findall((text or "").lower())
    if "".join(found).isalpha():
        return found
    # the pattern also takes numerals such as a superscript two or a half
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = np.uint64(22)


def _extend(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings, from those of the strings without their last character."""
    mixed = (hashes ^ codes) * _MULTIPLIER
    return mixed ^ (mixed >> np.uint64(29))


def _codes(group: list[str]) -> np.ndarray:
    """Code points of words of one length: words x positions."""
    points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points.reshape(len(group), -1).astype(np.uint64) + np.uint64(1)


class Segmenter:
    """Forward and backward passes over the segmentations of words.

    Pieces are looked up for many words at once, in a table by their hash.
    """

    def __init__(self, pieces: list[str]):
        self._number = {p: k for k, p in enumerate(pieces)}
        self._none = len(pieces)  # the number of what is no piece: its probability is 0
        self._hashes = np.zeros(len(pieces) + 1, dtype=np.uint64)
        for places, group in self._grouped(pieces):
            if group[0]:
                hashes = np.zeros(len(group), dtype=np.uint64)
                for column in _codes(group).T:
                    hashes = _extend(hashes, column)
                self._hashes[places] = hashes
        named = np.array([k for k, p in enumerate(pieces) if p], dtype=np.int32)
        slots = self._hashes[named] >> (np.uint64(64) - _SLOT_BITS)
        self._slots = np.full(1 << int(_SLOT_BITS), self._none, dtype=np.int32)
        self._slots[slots] = named  # of several the last one
        crowded = named[self._slots[slots] != named]
        bits = 16
        while True:  # wide enough that each of the others has a slot of its own
            self._second_mask = np.uint64((1 << bits) - 1)
            slots = (self._hashes[crowded] >> np.uint64(16)) & self._second_mask
            if len(np.unique(slots)) == len(crowded):
                break
            bits += 1
        self._second = np.full(1 << bits, self._none, dtype=np.int32)
        self._second[slots] = crowded

    def _pieces_of(self, hashes: np.ndarray) -> np.ndarray:
        held = self._slots[hashes >> (np.uint64(64) - _SLOT_BITS)]
        equal = self._hashes[held] == hashes
        found = np.where(equal, held, self._none)
        taken = np.flatnonzero(~equal & (held != self._none))
        if len(taken):  # pieces whose slot was taken are in a second table
            second = self._second[(hashes[taken] >> np.uint64(16)) & self._second_mask]
            found[taken] = np.where(self._hashes[second] == hashes[taken], second, self._none)
        return found

    def _grouped(self, words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """Places and words of one length together; those of more than LONG characters one by one."""
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for length, members in by_length.items():
            size = 4096 if length <= LONG else 1
            for begin in range(0, len(members), size):
                part = members[begin: begin + size]
                yield part, [words[k] for k in part]

    def _spans(self, group: list[str]) -> list[tuple[int, int, np.ndarray]]:
        """(start, stop, piece of each word) where any word has one, by start; unknown characters are piece 0."""
        codes, found = _codes(group), []
        length = codes.shape[1]
        columns = np.ascontiguousarray(codes.T)
        for start in range(length):
            hashes = np.zeros(len(group), dtype=np.uint64)
            for stop in range(start + 1, min(length, start + PIECE_CHARS) + 1):
                hashes = _extend(hashes, columns[stop - 1])
                pieces = self._pieces_of(hashes)
                if stop == start + 1:
                    found.append((start, stop, np.where(pieces == self._none, 0, pieces)))
                elif (pieces != self._none).any():
                    found.append((start, stop, pieces))
        return found

    def spans(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end position 1..len: (start, piece) of the pieces that end there, unknown characters included."""
        number, found = self._number, []
        for stop in range(1, len(word) + 1):
            here = [(start, number[word[start:stop]]) for start in range(max(0, stop - PIECE_CHARS), stop)
                    if word[start:stop] in number]
            if not here or here[-1][0] != stop - 1:
                here.append((stop - 1, 0))
            found.append(here)
        return found

    def log_probability(self, word: str, table: np.ndarray) -> np.ndarray:
        """Log of the word's probability in each language; ``table`` is pieces x languages."""
        number = self._number
        alpha = [np.ones(table.shape[1])]  # the last PIECE_CHARS positions, scaled
        total = np.zeros(table.shape[1])
        for stop in range(1, len(word) + 1):
            begin = max(0, stop - PIECE_CHARS)
            sums = np.zeros(table.shape[1])
            for start in range(begin, stop):
                piece = number.get(word[start:stop])
                if piece is None:
                    if start != stop - 1:
                        continue
                    piece = 0
                sums = sums + alpha[start - stop] * table[piece]
            alpha.append(sums)
            if len(alpha) > PIECE_CHARS:
                alpha.pop(0)
            if stop % 8 == 0:  # rescaled, so that long words do not underflow
                alpha = [a / sums for a in alpha]
                total = total + np.log(sums)
        return total + np.log(alpha[-1])

    def log_probabilities(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """``log_probability`` of many words, those of equal length together."""
        out = np.empty((len(words), table.shape[1]))
        padded = np.vstack([table, np.zeros(table.shape[1])])
        for places, group in self._grouped(words):
            length = len(group[0])
            if length > LONG:
                out[places[0]] = self.log_probability(group[0], table)
                continue
            alpha = np.zeros((length + 1, len(group), table.shape[1]))
            alpha[0] = 1.0
            for start, stop, pieces in self._spans(group):
                alpha[stop] += alpha[start] * padded[pieces]
            out[places] = np.log(alpha[length])
        return out

    def expected(self, words: list[str], times: list[int], weights: np.ndarray) -> np.ndarray:
        """The expected number of uses of each piece over all segmentations, ``times`` each."""
        padded, sums = np.append(weights, 0.0), np.zeros(self._none + 1)
        plain = [float(v) for v in weights]
        for places, group in self._grouped(words):
            length = len(group[0])
            if length > LONG:
                self.add_expected(group[0], times[places[0]], plain, sums)
                continue
            spans = self._spans(group)
            alpha, beta = np.zeros((2, length + 1, len(group)))
            alpha[0] = 1.0
            for start, stop, pieces in spans:
                alpha[stop] += alpha[start] * padded[pieces]
            beta[length] = np.array([times[k] for k in places]) / alpha[length]
            used = []
            for start, stop, pieces in reversed(spans):
                uses = padded[pieces] * beta[stop]
                beta[start] += uses
                used.append(uses * alpha[start])
            sums += np.bincount(np.concatenate([pieces for _, _, pieces in reversed(spans)]), weights=np.concatenate(used),
                                minlength=len(sums))
        return sums[:-1]

    def add_expected(self, word: str, times: float, weights: list[float], into: np.ndarray) -> None:
        """Adds the expected number of uses of each piece, over all segmentations, to ``into``."""
        spans = self.spans(word)
        length = len(word)
        scale = np.ones(length + 1)  # position k's sums are divided by the product of scale[1..k]
        forward = [1.0] + [0.0] * length
        for stop, here in enumerate(spans, 1):
            total = 0.0
            for start, piece in here:
                value = forward[start] * weights[piece]
                total += value / scale[start + 1: stop].prod() if length > LONG else value
            if length > LONG:
                scale[stop], total = total, 1.0
            forward[stop] = total
        backward = [0.0] * length + [1.0 / forward[length]]
        for stop in range(length, 0, -1):
            for start, piece in spans[stop - 1]:
                value = weights[piece] * backward[stop]
                if length > LONG:
                    value /= scale[start + 1: stop + 1].prod()
                backward[start] += value
                into[piece] += times * value * forward[start]


@dataclass(frozen=True)
class Model:
    """``table``: pieces x languages, probabilities; ``prior``: log share of the languages' documents."""

    pieces: list[str]
    languages: list[str]
    table: np.ndarray
    prior: np.ndarray


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a batch counted by language; a row without a word (NULL) counts the language's documents."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = text_words(text.as_py())
            if found:
                here = counts.setdefault(lang, Counter())
                here.update(found)
                here[None] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang for lang, c in counts.items() for _ in c], pa.string()),
             pa.array([w for c in counts.values() for w in c], pa.string()),
             pa.array([n for c in counts.values() for n in c.values()], pa.int64())], ["lang", "word", "n"])


def _expected(shared, languages: list[str]):
    """This task's expected piece counts, by language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = shared.value
        segmenter, index = Segmenter(pieces), {lang: k for k, lang in enumerate(languages)}
        sums = np.zeros((len(languages), len(pieces)))
        for batch in batches:
            words: dict[str, tuple[list, list]] = {}
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                here = words.setdefault(lang, ([], []))
                here[0].append(MARK + word)
                here[1].append(n)
            for lang, (names, times) in words.items():
                k = index[lang]
                sums[k] += segmenter.expected(names, times, table[:, k])
        lang, piece = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(sums[lang, piece], pa.float64())],
            ["lang", "piece", "n"])
    return run


def fit(scratch: Scratch, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", path: str = VOCABULARY,
        rounds: int = ROUNDS) -> Model:
    """The model learned from the text and language of all rows of ``docs`` whose language is not NULL."""
    spark = docs.sparkSession
    labelled = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")) \
        .filter("lang IS NOT NULL")
    counts = labelled.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word") \
        .agg(F.sum("n").alias("n"))
    counts = scratch.table(counts, "words")
    documents = counts.filter("word IS NULL").orderBy("lang").collect()  # a row a language
    languages = [r.lang for r in documents]
    pieces = vocabulary(path)
    table = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    table[0] = 1e-6
    # few bytes, much work: spread over as many tasks as a shuffle has
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = counts.filter("word IS NOT NULL").repartition(tasks, "lang", "word")
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((pieces, table))
        sums = words.mapInArrow(_expected(shared, languages), "lang int, piece int, n double") \
            .groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()  # at most languages x pieces
        expected = np.full(table.shape, SMOOTHING)
        for lang, piece, n in sums:
            expected[piece, lang] += n
        table = np.maximum(expected / expected.sum(axis=0), LEAST)
    total = sum(r.n for r in documents)
    return Model(pieces, languages, table, np.array([math.log(r.n / total) for r in documents]))


class _Words:
    """Log probabilities of the words seen so far; more than CACHED of them start anew."""

    def __init__(self, model: Model):
        self._model, self._segmenter = model, Segmenter(model.pieces)
        self._place: dict[str, int] = {}
        self._values = np.empty((1024, len(model.languages)))

    def sums(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text the sum of its words' log probabilities, by language."""
        every = set().union(*texts)
        new = every.difference(self._place)
        if len(self._place) + len(new) > CACHED:
            self._place, new = {}, every
        if new:
            names, begin = sorted(new), len(self._place)
            end = begin + len(names)
            if end > len(self._values):
                more = np.empty((max(end, 2 * len(self._values)) - len(self._values), self._values.shape[1]))
                self._values = np.concatenate([self._values, more])
            self._values[begin:end] = self._segmenter.log_probabilities([MARK + w for w in names], self._model.table)
            self._place.update(zip(names, range(begin, end)))
        find = self._place.__getitem__
        return [self._values.take(np.fromiter(map(find, t), np.int64, len(t)), axis=0).sum(axis=0) for t in texts]


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = _Words(model)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [text_words(t.as_py()) if model.languages else [] for t in part.column(0)]
                said = []
                for text, logs in zip(texts, words.sums(texts)):
                    if not text:
                        said.append(("und", 0.0))
                        continue
                    logs = model.prior + logs
                    best = int(np.argmax(logs))
                    said.append((model.languages[best], round(1.0 / float(np.exp(logs - logs[best]).sum()), 6)))
                language = pa.StructArray.from_arrays(
                    [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                    ["lang_pred", "score"])
                yield pa.RecordBatch.from_arrays([language, *part.columns[1:]], ["language", *part.schema.names[1:]])
    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) and a struct ``language`` (or a free name): lang_pred, score.

    Only the text is read for the prediction; the other columns pass by.
    """
    carry = list(docs.columns) if carry is None else carry
    name = fresh(carry, "language")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), row)
    language = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([T.StructField("language", language), rows.schema["row"]])
    said = rows.mapInArrow(_predict(shared), schema)
    return said.select("row.*", F.col("language").alias(name))
