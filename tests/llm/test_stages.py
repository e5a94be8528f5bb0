"""Each pipeline stage on odd rows (NULLs, empty, long, tied and repeated ones, clashing columns), and the whole chain."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from churnlens.llm import mixing, quality
from churnlens.llm.common import Scratch
from churnlens.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm import brute

CLASH = ["quality", "hits", "mix", "shard", "copy", "keeper", "kept_id", "text_md5", "shard_number", "row", "id", "part"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def _sentence(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 4099}" for k in range(n))


PASSAGE = _sentence(1, 60)
LONG = " ".join(f"x{k % 9973}y{k % 7}" for k in range(40_000))
TEXTS = [
    (1, _sentence(3, 80), "en", "a"), (2, _sentence(3, 80) + " tail", "en", "b"), (2, _sentence(4, 90), "en", "b"),
    (3, PASSAGE, "en", "a"), (3, PASSAGE, "en", "a"), (None, PASSAGE, "en", None), (None, _sentence(5, 70), None, None),
    (4, None, "en", "a"), (5, "", None, "a"), (6, " \n\t", "de", None), (7, "too short", "en", "a"), (8, LONG, "en", "c"),
    (9, "again and again " * 30, "en", "c"), (10, _sentence(6, 100), "de", "c"), (11, _sentence(6, 100).upper(), "de", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["x"] * len(CLASH)) for i, t, lang, s in TEXTS], SCHEMA)


@pytest.fixture()
def sf_dir(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, " ".join(LONG.split()[500:520])), (4, "")], "item_id long, text string") \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def _texts(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


ALL = Counter((i, t, s) for i, t, _, s in TEXTS)


def test_quality_rules(spark, docs):
    out = corpus_pipeline.quality_rules(spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    passing = Counter({k: n for k, n in ALL.items() if not brute.quality(k[1])[5]})
    assert not _texts(out) - passing  # what fails the base rules goes
    with Scratch(spark, "quality-test") as scratch:
        verdicts = quality.judge(scratch, docs).select("doc_id", "text", "source", "quality_1.kept").collect()
    assert _texts(out) == Counter((r.doc_id, r.text, r.source) for r in verdicts if r.kept)
    assert len(_texts(out)) >= 5 and (8, LONG, "c") in _texts(out)


def test_near_dedup(spark, docs):
    out = corpus_pipeline.near_dedup(spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    gone = [(2, _sentence(3, 80) + " tail", "b"), (None, PASSAGE, None), (11, _sentence(6, 100).upper(), "c"), (3, PASSAGE, "a")]
    assert _texts(out) == ALL - Counter(gone)


def test_decontamination(spark, docs, sf_dir):
    out = corpus_pipeline.decontamination(spark, docs, sf_dir)
    assert out.columns == docs.columns
    # 20 of 40,000 words of the long text are benchmark words: too few
    assert _texts(out) == Counter({k: n for k, n in ALL.items() if k[1] != PASSAGE})


def test_mixing_sources(spark, docs):
    out = corpus_pipeline.mixing_sources(spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    taken = _texts(out)
    assert set(taken) <= set(ALL) and all(n <= 3 * ALL[k] for k, n in taken.items())
    with Scratch(spark, "mix-test") as scratch:
        copies = Counter()
        for r in mixing.mix(scratch, docs).select("doc_id", "text", "source", "mix_1.copies").collect():
            copies[r.doc_id, r.text, r.source] += r.copies
    assert taken == +copies


def test_shards(spark, docs):
    out = corpus_pipeline.shards(spark, docs, SF_SMALL)
    assert out.columns == [*docs.columns, "shard_number_1", "shard_slot"] and _texts(out) == ALL
    places = Counter((r.shard_number_1, r.shard_slot) for r in out.collect())
    assert max(places.values()) == 1 and {s for s, _ in places} == set(range(8))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_no_documents(spark, docs, sf_dir, name, stage):
    out = stage(spark, docs.filter("false"), sf_dir)
    assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns


def test_the_chain_keeps_exactly_what_its_stages_keep(spark):
    """Up to the mix the documents are those of the plain versions; the mix takes each as often as it says."""
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    kept = {r.doc_id for r in QUERIES["op10_quality"](spark, SF_SMALL).collect() if r.kept}
    left = [(i, t) for i, t in docs if i in kept]
    groups = brute.near_groups(left, k=5, percent=80)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    clean = sorted(r[0] for r in brute.decontaminate(left, items) if not r[5])
    with Scratch(spark, "chain-test") as scratch:
        mixed = mixing.mix(scratch, table.filter(F.col("doc_id").isin(clean)))
        expected = Counter({r.doc_id: r.copies for r in mixed.select("doc_id", "mix.copies").collect()})
    assert sorted(expected) == clean
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert Counter(r.doc_id for r in rows) == +expected
    whole = {r.doc_id: tuple(r) for r in table.collect()}
    assert all(tuple(r)[: len(table.columns)] == whole[r.doc_id] for r in rows)
