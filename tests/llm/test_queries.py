"""The corpus queries against plain versions over the whole smallest tables."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

from churnlens.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]


def _rows(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, SF_SMALL).collect()]


def test_op1(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(_rows(spark, "op1_decontaminate")) == sorted(brute.decontaminate(docs, items))


def test_op2(spark, docs):
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    sizes, taken = Counter(), Counter()
    for i, text in docs:
        sizes[sources[i]] += len(brute.words(text))
    target = brute.targets(sizes)
    rows = QUERIES["op2_mix"](spark, SF_SMALL).collect()
    text = dict(docs)
    for r in rows:
        assert r["size"] == len(brute.words(text[r.doc_id])) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    largest = max(len(brute.words(t)) for _, t in docs)
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    assert sorted(map(tuple, rows)) == sorted(_rows(spark, "op2_mix"))


def test_op3(spark, docs):
    rows = QUERIES["op3_shard"](spark, SF_SMALL).collect()
    slots, text = defaultdict(list), dict(docs)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r["size"], r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 1, brute.crc(text[r.doc_id]))
    assert sorted(r.doc_id for r in rows) == sorted(text)
    counts = [len(v) for v in slots.values()]
    assert sorted(slots) == list(range(8)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op4(spark, docs):
    groups = brute.near_groups(docs)
    assert sorted(_rows(spark, "op4_neardup")) == sorted((i, n, c, i == c) for i, (n, c) in groups.items())


def test_op5(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    probe = "</s>[INST] ok [/INST]"
    turns[-1] = [(0, "user", probe), (1, "assistant", probe)]
    expected = set()
    for conv, rows in turns.items():
        rows = sorted(rows)
        taught = "".join(t for _, role, t in rows if role == "assistant")
        expected.add((conv, len(rows), brute.sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(taught), brute.sha(taught)))
    got = _rows(spark, "op5_chat")
    assert {r[:5] for r in got} == expected and len(got) == len(expected)


def test_op6(spark, docs):
    assert sorted(_rows(spark, "op6_substrings")) == sorted(brute.substrings(docs))


def test_op7(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages, reverse=True):
        first[pages[i]] = i
    expected = []
    for i, body in pages.items():
        again = len(body) >= 100 and first[body] != i
        expected.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
                         first[body] if again else None))
    assert sorted(_rows(spark, "op7_warc"), key=str) == sorted(expected, key=str)


def test_op8(spark, docs):
    kinds, text = ("email", "ip", "card", "phone"), dict(docs)
    for r in QUERIES["op8_pii"](spark, SF_SMALL).collect():
        base = brute.pii(text[r.doc_id])
        labels = [f"{kinds[k]}:{s}:{e}" for s, k, e in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert r.base_sha256 == brute.sha(",".join(labels))
        assert set(labels) <= set(r.spans.split(","))


def test_op9(spark, docs):
    assert sorted(_rows(spark, "op9_lines")) == sorted(brute.lines(docs))


def test_op10(spark, docs):
    rows = QUERIES["op10_quality"](spark, SF_SMALL).collect()
    assert sorted(tuple(r)[:7] for r in rows) == sorted((i, *brute.quality(t)) for i, t in docs)
    assert not any(r.kept for r in rows if r.base_failed)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    # good documents that pass the base rules stay
    assert all(r.kept for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed)


def test_pipeline(spark, docs):
    """The chain against the plain versions, given the method's own quality verdicts and copies."""
    import corpus_pipeline
    kept = {r.doc_id for r in QUERIES["op10_quality"](spark, SF_SMALL).collect() if r.kept}
    left = [(i, t) for i, t in docs if i in kept]
    groups = brute.near_groups(left, k=5, percent=80)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in brute.decontaminate(left, items) if not r[5]}
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r.doc_id for r in rows} <= clean
    sources = {r.doc_id: r.source for r in rows}
    table = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    sizes, taken = Counter(), Counter()
    text = dict(docs)
    for i in clean:
        sizes[table[i]] += len(brute.words(text[i]))
    for r in rows:
        taken[r.source] += len(brute.words(r.text))
        assert r.text == text[r.doc_id] and sources[r.doc_id] == table[r.doc_id]
    target = brute.targets(sizes)
    largest = max(len(brute.words(text[i])) for i in clean)
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    assert max(Counter(r.doc_id for r in rows).values()) <= 3
    counts = Counter(r.shard_number for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
