"""Language identification: sums over segmentations by enumeration, held-out accuracy, odd rows."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import langid
from churnlens.llm.common import Scratch
from churnlens.llm.queries import QUERIES
from tests.conftest import SF_ORACLE

PIECES = ["", "a", "ab", "b", "ba", "▁", "▁a", "bab"]
SCHEMA = "doc_id long, text string, lang string, language int, lang_pred string, score string"


def segmentations(word, pieces):
    """Every segmentation into pieces; a character that is no piece is the unknown one."""
    if not word:
        yield []
    for stop in range(1, len(word) + 1):
        head = word[:stop]
        if head in pieces or (stop == 1 and head not in pieces):
            number = pieces.index(head) if head in pieces else 0
            for rest in segmentations(word[stop:], pieces):
                yield [number, *rest]


@pytest.fixture(scope="module")
def table():
    draw = np.random.default_rng(1).random((len(PIECES), 3)) + 0.05
    return draw / draw.sum(axis=0)


@pytest.mark.parametrize("word", ["▁", "▁a", "▁abab", "▁bbabab", "▁xabx", "▁aababbabab"])
def test_forward_sums_all_segmentations(table, word):
    segmenter = langid.Segmenter(PIECES)
    every = [np.prod(table[s], axis=0) for s in segmentations(word, PIECES)]
    expected = np.log(np.sum(every, axis=0))
    assert segmenter.log_probability(word, table) == pytest.approx(expected)
    assert segmenter.log_probabilities([word, "▁b", word], table)[2] == pytest.approx(expected)
    uses = np.zeros(len(PIECES))
    weights = [float(v) for v in table[:, 1]]
    segmenter.add_expected(word, 2.0, weights, uses)
    total = sum(p[1] for p in every)
    counts = sum(p[1] / total * np.bincount(s, minlength=len(PIECES)) for p, s in zip(every, segmentations(word, PIECES)))
    assert uses == pytest.approx(2 * counts)
    assert segmenter.expected([word, "▁ab", word], [1, 0, 1], table[:, 1]) == pytest.approx(2 * counts)


def test_long_words_do_not_underflow(table, monkeypatch):
    segmenter = langid.Segmenter(PIECES)
    word = "▁" + "abbab" * 4000
    log = segmenter.log_probability(word, table * 1e-6)
    assert np.isfinite(log).all() and (log < -10_000).all()
    assert segmenter.log_probabilities([word], table * 1e-6)[0] == pytest.approx(log)
    uses = np.zeros(len(PIECES))
    segmenter.add_expected(word, 1.0, [1e-9 * float(v) for v in table[:, 0]], uses)
    lengths = [max(len(p), 1) for p in PIECES]
    assert np.dot(uses, lengths) == pytest.approx(len(word))  # the pieces of a segmentation cover the word
    short, long = np.zeros(len(PIECES)), np.zeros(len(PIECES))
    segmenter.add_expected("▁abbabxab", 1.0, [float(v) for v in table[:, 0]], short)
    monkeypatch.setattr(langid, "LONG", 2)
    segmenter.add_expected("▁abbabxab", 1.0, [float(v) for v in table[:, 0]], long)
    assert long == pytest.approx(short)


def test_held_out_accuracy(spark):
    rows = QUERIES["op11_langid"](spark, SF_ORACLE).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id][0] for r in unseen)
    assert len(unseen) > 100 and right >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id][1] or ""))


TRAIN = [(1, "the cat and the dog are here", "en"), (2, "le chat et le chien sont ici", "fr"), (3, "the house", "en"),
         (4, "la maison", "fr"), (5, "nothing", None), (6, None, "xx"), (7, "12 34", "yy"), (8, "the cat and the dog are here", "en")]


def test_odd_rows_and_columns(spark):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in TRAIN], SCHEMA)
    asked = [(1, "the dog", "fr"), (1, "the dog", None), (None, "le chien", "en"), (2, None, "en"), (3, "", "en"), (4, "1 2 ! 3", "en"),
             (5, "x" * 100_000, "en"), (6, "the " * 50_000, "fr"), (7, "日本語", None), (8, "ʰ", None), (9, "½ ² Ⅷ _ ٣", "en")]
    with Scratch(spark, "langid") as scratch:
        model = langid.fit(scratch, docs)
        assert model.languages == ["en", "fr"]  # a language without a word teaches nothing
        assert np.exp(model.prior) == pytest.approx([3 / 5, 2 / 5])
        out = langid.predict(spark.createDataFrame([(*r, 1, "x", "y") for r in asked], SCHEMA), model)
        assert out.columns == [*docs.columns, "language_1"]
        said = [(r.text, r.language_1.lang_pred, r.language_1.score) for r in out.collect()]
    by_text = {t: p for t, p, _ in said}
    assert by_text["the dog"] == by_text["the " * 50_000] == "en" and by_text["le chien"] == "fr"
    assert [p for t, p, s in said if t in (None, "", "1 2 ! 3", "½ ² Ⅷ _ ٣")] == ["und"] * 4
    assert all(s == 0 for t, p, s in said if p == "und") and all(math.isfinite(s) and 0 <= s <= 1 for _, _, s in said)
    assert by_text["日本語"] in ("en", "fr") and by_text["ʰ"] in ("en", "fr")
    assert len({(p, s) for t, p, s in said if t == "the dog"}) == 1  # the row's own language has no say


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in TRAIN], SCHEMA)
    with Scratch(spark, "langid") as scratch:
        model = langid.fit(scratch, docs.filter(F.col("lang").isNull()))
        assert {(r.language_1.lang_pred, r.language_1.score) for r in langid.predict(docs, model).collect()} == {("und", 0.0)}
        assert langid.predict(docs.filter("false"), model).count() == 0
