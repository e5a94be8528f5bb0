"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import io
import itertools
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnlens.llm import chat, decontaminate, linededup, mixing, neardup, pii, quality, sharding, substrings, warc
from churnlens.llm.common import Scratch
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, mix int, shard int, " \
         "quality string, hits int, lines int, repeats int, pii int, tie int, mid int, size int, id string"
LONG = " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000))
PASSAGE = " ".join(f"p{k}" for k in range(70))
TEXTS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "One", None, None), (5, "one\nONE", "xx", "b"),
    (6, PASSAGE, "en", "b"), (7, f"start {PASSAGE} end", "en", "c"), (8, PASSAGE, "en", "c"), (8, PASSAGE, "en", "c"),
    (9, LONG, "en", "a"), (10, LONG + " tail", "en", "a"), (None, PASSAGE, "en", "a"), (None, None, None, None),
    (11, "A long enough line\nother\nA long enough line ", "en", "d"), (12, " a LONG enough line", "en", "d"),
    (13, "call +1 (234) 555-0199 or x@y.example.com at 10.0.0.1, 4539578763621486", "en", "d"),
    (14, "é" * 300 + " ü@b.c 1.2.3.999 😀 a@b.c_d@e.f", "en", "d"),
]
PLAIN = [(i, t) for i, t, _, _ in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", 1, 2, "q", 3, 4, 5, 6, 7, 8, 9, "i") for i, t, lang, s in TEXTS],
                                 SCHEMA)


@pytest.fixture()
def scratch(spark):
    with Scratch(spark, "edges") as s:
        yield s


@pytest.fixture()
def none(docs):
    return docs.filter("false")


def test_mixing(scratch, docs, none):
    out = mixing.mix(scratch, docs)
    assert out.columns == [*docs.columns, "mix_1"] and out.count() == len(TEXTS)
    for r in out.select("text", F.col("mix_1.size").alias("n"), "mix_1.taken").collect():
        assert r.n == len(brute.words(r.text)) and r.taken <= 3 * r.n
    with Scratch(docs.sparkSession, "empty") as other:
        assert mixing.mix(other, none).count() == 0


def test_sharding(scratch, docs, none):
    rows = sharding.shard(scratch, docs).select("shard_1.*").collect()
    counts = [sum(r.shard == k for r in rows) for k in range(8)]
    assert len(rows) == len(TEXTS) and max(counts) - min(counts) <= 1
    with Scratch(docs.sparkSession, "empty") as other:
        assert sharding.shard(other, none).count() == 0


@pytest.mark.parametrize("n_axes,bits", [(2, 3), (3, 2)])
def test_hilbert_curve(spark, n_axes, bits):
    cells = list(itertools.product(range(2 ** bits), repeat=n_axes))
    frame = spark.createDataFrame(cells, ", ".join(f"x{k} long" for k in range(n_axes)))
    index = {tuple(r)[:-1]: r.at for r in frame.select("*", sharding.hilbert_index(
        [F.col(f"x{k}") for k in range(n_axes)], bits).alias("at")).collect()}
    assert brute.hilbert_neighbours(n_axes, bits, index)


def test_near_duplicates(spark, scratch, docs, none):
    groups_of = neardup.near_duplicates(scratch, docs, words=3, percent=85)
    rows = groups_of.collect()
    plain = dict(p for p in PLAIN if p[0] is not None)
    groups = brute.near_groups(list(plain.items()))
    assert len(rows) == len(TEXTS)
    assert all((r.n_shingles, r.component_id) == groups[r.id] for r in rows if r.id is not None)
    # without an id: the group of the text, none without words
    assert sorted((r.n_shingles, r.component_id or 0) for r in rows if r.id is None) == [(0, 0), (68, groups[6][1])]
    kept = neardup.keep_one(docs, groups_of)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted({c for _, c in groups.values()})
    assert [r.text for r in kept.filter("doc_id IS NULL").collect()] == [None]
    with Scratch(spark, "empty") as other:
        nothing = neardup.near_duplicates(other, none)
        assert nothing.count() == 0 and neardup.keep_one(none, nothing).count() == 0


def test_repeated_ids_lose_no_other_text(spark, scratch):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (2, a), (3, c), (3, c), (None, c), (None, b + " tail"), (None, "only here of all"), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in neardup.keep_one(docs, neardup.near_duplicates(scratch, docs)).collect()]
    # one document a group, the smallest id; rows without words all stay
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (3, c), (None, "only here of all"), (4, ""), (4, "")], key=str)


def test_signatures_bound_the_links():
    draw = np.random.default_rng(2)
    for n, common in ((200, 185), (1000, 920), (12, 11)):
        pool = np.unique(draw.integers(0, 2 ** 63, 3 * n, dtype=np.uint64))
        both, left, right = pool[:common], pool[common: n], pool[n: 2 * n - common]
        a, b = np.concatenate([both, left]), np.concatenate([both, right])
        similarity = common / (2 * n - common)
        sigs = [neardup._signatures(pa.array([neardup.signature(x)])) for x in (a, b)]
        agreement = sum(int((x == y).sum()) for x, y in zip(*sigs))
        total = neardup.COORDINATES + neardup.EXTRA
        assert abs(agreement / total - similarity) < 5 * (similarity * (1 - similarity) / total) ** 0.5
        if similarity >= 0.8:
            assert agreement >= neardup.least_agreement(80)
    assert neardup.least_agreement(85) > 0.7 * (neardup.COORDINATES + neardup.EXTRA) > neardup.least_agreement(80)


def test_near_duplicates_large_mixed_region(spark, scratch):
    """More similar texts than a sorted neighbourhood holds, linked and unlinked ones in the same regions."""
    shared = [f"s{k}" for k in range(80)]
    rows = [(i, " ".join(shared + [f"u{i // 2}v{k}" for k in range(14)] + [f"e{i}"])) for i in range(60)]
    got = {r.id: r.component_id for r in neardup.near_duplicates(
        scratch, spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    assert got == {i: c for i, (_, c) in brute.near_groups(rows).items()}


def test_substrings(scratch, docs, none):
    rows = substrings.remove_repeats(scratch, docs).select("doc_id", "repeats_1.*").collect()
    last = 10 ** 9
    expected = brute.substrings([(last if i is None else i, t) for i, t in PLAIN])
    got = [(last if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in rows]
    assert sorted(got) == sorted(expected)
    with Scratch(docs.sparkSession, "empty") as other:
        assert substrings.remove_repeats(other, none).count() == 0


def test_colliding_hashes_remove_nothing(spark):
    """Words hashed to a few values only: windows of different words look equal, and none is removed for it."""
    def weak(words):
        return np.array([len(w) % 2 + 1 for w in words], dtype=np.uint64)
    a, b = (" ".join(f"{x}{k:04d}" for k in range(120)) for x in "ab")
    rows = [(1, a), (2, b), (3, "z " * 10 + a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    with Scratch(spark, "weak") as scratch:
        got = {r.doc_id: r.repeats.n_removed for r in substrings.remove_repeats(scratch, frame, hash_words=weak).collect()}
    assert got[1] == got[2] == 0  # they share no word
    with Scratch(spark, "strong") as scratch:
        got = {r.doc_id: r.repeats.n_removed for r in substrings.remove_repeats(scratch, frame).collect()}
    assert got == {1: 0, 2: 0, 3: 120}


def test_lines(scratch, docs, none):
    rows = linededup.apply_bitmaps(docs, linededup.drop_bitmaps(scratch, docs)).select("doc_id", "lines_1.*").collect()
    last = 10 ** 9
    expected = brute.lines([(last if i is None else i, t) for i, t in PLAIN])
    got = [(last if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, brute.sha(r.kept_text)) for r in rows]
    assert sorted(got) == sorted(expected)
    with Scratch(docs.sparkSession, "empty") as other:
        assert linededup.apply_bitmaps(none, linededup.drop_bitmaps(other, none)).count() == 0


def test_decontaminate(spark, scratch, docs, none):
    items = [(1, PASSAGE), (2, "ONE"), (3, None), (4, "..."), (2, "one"), (5, " ".join(LONG.split()[:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_hits(scratch, docs, bench).select("doc_id", "hits_1.*").collect()
    got = [(str(r.doc_id), r.n_words, r.n_hit, len(r.item_ids), brute.sha(",".join(r.item_ids)), r.contaminated) for r in rows]
    assert sorted(got) == sorted((str(r[0]), *r[1:]) for r in brute.decontaminate(PLAIN, items))
    with Scratch(spark, "empty") as other:
        assert decontaminate.find_hits(other, none, bench).count() == 0
        assert not decontaminate.find_hits(Scratch(spark, "none"), docs, bench.filter("false")).filter("hits_1.n_hit > 0").count()


def test_quality(scratch, docs, none):
    rows = quality.judge(scratch, docs).select("text", "quality_1.*").collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(r.text)
    with Scratch(docs.sparkSession, "empty") as other:
        assert quality.judge(other, none).count() == 0


def test_quality_rejects_symbol_noise(spark, scratch):
    plain = [(i, " ".join(f"{w}{(i * k) % 7}" for k, w in enumerate(["the", "sea", "of", "words", "and"] * 30)), "en")
             for i in range(60)]
    noise = [(99, " ".join(f"x{k}#$%&*" for k in range(200)), "en")]
    frame = spark.createDataFrame(plain + noise, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.quality.kept or r.quality.base_failed for r in quality.judge(scratch, frame).collect()}
    assert not kept[99] and all(kept[i] for i, *_ in plain)


def test_pii(scratch, docs, none):
    for r in pii.find_spans(scratch, docs).collect():
        assert [tuple(s) for s in r.pii_1.base] == [(s, k, e) for s, k, e in brute.pii(r.text)]
    with Scratch(docs.sparkSession, "empty") as other:
        assert pii.find_spans(other, none).count() == 0


def test_pii_model_adds_joined_cards(spark, scratch):
    """Card numbers that the base pattern runs together are proposed singly and selected by the trees."""
    def card(n):
        body = f"45{n:013d}"
        return next(body + str(d) for d in range(10) if brute._luhn(body + str(d)))
    rows = [(i, f"pay {card(i * 7919)} now, order {10 ** 11 + i * 104729} of {i}-2020-{i % 12:02d}-11 ref 123 4567 {i}")
            for i in range(300)]
    rows.append((300, f"two {card(5)} {card(6)} cards"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.pii.spans] for r in pii.find_spans(scratch, frame).collect()}
    assert spans[300] == [(4, 2, 20), (21, 2, 37)]
    assert all(spans[i] == brute.pii(t) for i, t in rows[:300])


def test_pii_thresholds_come_from_all_documents(spark, scratch):
    """Three cards in the fitted documents and nine elsewhere, fewer than any held-out share would hold."""
    cards = ["4539578763621486", "4785380592391139", "4737097684299439", "4994226020900891"] * 3
    rows = [(i, f"pay {c} now, order {10 ** 11 + i * 104729} ref 123 4567 {i}") for i, c in enumerate(cards)]
    rows.append((12, f"two {cards[0]} {cards[1]} cards"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.pii.spans] for r in pii.find_spans(scratch, frame, sample_docs=5).collect()}
    assert spans[12] == [(4, 2, 20), (21, 2, 37)]
    assert all(spans[i] == brute.pii(t) for i, t in rows[:12])


def test_pii_rewritten_forms_are_selected(spark, scratch):
    """Addresses with at/dot and phones without ``+`` are added to a corpus that holds the usual forms."""
    def text(i):
        email, phone = f"user{i}@mail{i % 7}.example.com", f"+1 ({200 + i}) 555-{1000 + i * 7}"
        order, day = f"order {10 ** 11 + i * 104729}", f"since {i % 31}-2020-{i % 12:02d}-11"
        return (f"mail {email} today", f"reach us, call {phone} now", f"{order} and {day}", f"write to {email} or {phone} soon",
                f"{order} call {phone}", f"{day} mail {email} of {order}", f"phone {phone}", f"the address {email}")[i % 8]
    rows = [(i, text(i)) for i in range(96)]
    hidden = {100: ("mail bob at mail3.example dot com today", "bob at mail3.example dot com", 0),
              101: ("mail eve(at)mail5.example.com today", "eve(at)mail5.example.com", 0),
              102: ("reach us, call 1 (743) 555-3824 now", "1 (743) 555-3824", 3),
              103: ("reach us, call 743-555-3824 now", "743-555-3824", 3)}
    prose = ["meet at noon.Then we go", "look at example.com first", "priced at 3.50 each", "see figure at page.two of it",
             "she works at acme.Inc now", "stay at home.Read a book"]
    frame = spark.createDataFrame(rows + [(i, t) for i, (t, _, _) in hidden.items()] + list(enumerate(prose, 200)),
                                  "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.pii.spans] for r in pii.find_spans(scratch, frame).collect()}
    for i, (text, form, kind) in hidden.items():
        assert spans[i] == [(text.index(form), kind, text.index(form) + len(form))]
    assert all(spans[i] == brute.pii(t) for i, t in rows)
    assert all(spans[i] == [] for i in range(200, 200 + len(prose)))  # the word "at" alone is no address


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/s[]INST \\ab\nSYé", max_size=40))
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape(chat.escape_role(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_fold_events(spark):
    log = [
        (1, 0, 0, "user", "m0", "delta", "hel"), (1, 1, 0, "user", "m0", "delta", "lo"),
        (1, 2, 1, "assistant", "m1", "delta", "bad"), (1, 3, 1, "assistant", "m1", "regenerate", None),
        (1, 4, 1, "assistant", "m1", "delta", "good"), (1, 5, 2, "user", "m2", "delta", "x"),
        (1, 6, 2, "user", "m2", "edit", "edited"), (1, 7, 2, "user", "m2", "delta", "!"),
        (1, 8, 3, "user", "m3", "delta", "gone"), (1, 9, 3, "user", "m3", "drop", None),
        (None, 0, None, None, "m4", "delta", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, role string, message string, kind string, text string")
    rows = chat.render(chat.fold_events(events)).collect()
    by = {r.conv_id: r for r in rows}
    assert chat.parse(by[1].formatted) == [("user", "hello"), ("assistant", "good"), ("user", "edited!")]
    assert chat.loss_text(by[1].formatted, by[1].loss) == "good"
    assert chat.parse(by[None].formatted) == [("", "")]
    assert chat.render(chat.fold_events(events.filter("false"))).count() == 0


def test_package_is_a_zip_file():
    members = [("a/b.gz", b"payload"), ("index", b"")]
    blob = warc.write_package(members) + b"\n"
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    found = warc.central_directory(lambda at, n: blob[at: at + n], len(blob))
    assert {k: blob[a: a + n] for k, (a, n) in found.items()} == dict(members)


def test_package_of_another_writer():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", b"123")
    blob = out.getvalue()
    found = warc.central_directory(lambda at, n: blob[at: at + n], len(blob))
    assert {k: blob[a: a + n] for k, (a, n) in found.items()} == {"x": b"123"}
    with pytest.raises(ValueError):
        warc.central_directory(lambda at, n: b"nothing"[at: at + n], 7)


def test_archives(spark, scratch):
    body = "<p>é</p>" * 40
    pages = spark.createDataFrame([(3, "u", body, 1), (1, None, body, 1), (1, "u", body, 1), (2, "a\nb", None, 1),
                                   (4, "u", "tiny", 1), (5, "u", "tiny", 1), (None, "u", body, 1)],
                                  "page_id long, url string, html string, digest int")
    records = warc.read_archives(spark, warc.write_archives(scratch, pages, archive_bytes=300))
    rows = sorted(map(tuple, records.select("page_id", "record_type", "refers_to", F.col("payload").cast("string")).collect()),
                  key=str)
    assert rows == sorted([(3, "revisit", 1, None), (1, "response", None, body), (1, "response", None, body),
                           (2, "response", None, ""), (4, "response", None, "tiny"), (5, "response", None, "tiny"),
                           (None, "revisit", 1, None)], key=str)
    with Scratch(spark, "empty") as other:
        folder = warc.write_archives(other, pages.filter("false"))
        assert warc.read_archives(spark, folder).count() == 0


def test_one_record_is_read_by_its_range(spark, scratch, monkeypatch):
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(
        F.col("id").cast("string"), 256), 400).alias("html")).coalesce(1)
    folder = warc.write_archives(scratch, pages, archive_bytes=1 << 30)
    located = warc.locate_records(spark, folder).collect()
    (path,) = {r.path for r in located}
    size = spark.read.format("binaryFile").load(folder).select("length").first().length
    one = next(r for r in located if r.page_id == 7)
    package = warc._Package(path)
    fields, payload = warc.read_record(package.read(one.offset, one.length))
    assert fields["Page-ID"] == "7" and package.bytes_read == one.length < size / 30
    # the index is found without the data: tail, directories and index only
    package = warc._Package(path)
    members = warc.central_directory(package.read, size)
    package.read(*members[warc.INDEX])
    assert package.bytes_read < size - members[warc.DATA][1] + 66_000
    asked = warc.read_records(warc.locate_records(spark, folder).filter("page_id IN (7, 8, 50)"))
    assert sorted(r.page_id for r in asked.collect()) == [7, 8, 50]
    opened = []

    class Counting(warc._Package):
        def read(self, offset, length):
            opened.append(length)
            return super().read(offset, length)
    monkeypatch.setattr(warc, "_Package", Counting)
    rows = [r for r in located if r.page_id in (7, 8, 50)]
    batch = pa.RecordBatch.from_pylist([{"path": r.path, "offset": r.offset, "length": r.length} for r in rows])
    assert sum(b.num_rows for b in warc._fetch(iter([batch]))) == 3
    assert opened == [rows[0].length + rows[1].length, rows[2].length]  # neighbours are one read


def test_package_beyond_four_gigabytes(spark, tmp_path):
    """A sparse file: its second member begins beyond the 32-bit fields and is found by the ZIP64 records."""
    gap, line = (1 << 32) + 12345, b'{"page": 5, "offset": 4294967400, "length": %d}\n'
    member = warc.write_record(5, "u", "response", hashlib.sha256(b"body").hexdigest(), b"body", None)
    lines = line % len(member)
    package = warc.write_package([(warc.DATA, b""), (warc.INDEX, lines)])
    # stretch the first member: everything behind its header moves up by ``gap``
    head = warc._LOCAL.size + len(warc.DATA) + 20
    moved = bytearray(package[head:])
    out = tmp_path / "large.zip"
    with open(out, "wb") as f:
        f.write(package[:head])
        f.seek(head + 4294967400)
        f.write(member)
        f.seek(head + gap)
        f.write(moved)
    # directory entries: sizes of the first member, offsets of the second, of the directory and of its end record
    blob = bytearray(moved)
    at = blob.find(b"PK\x01\x02")
    extra = at + warc._CENTRAL.size + len(warc.DATA) + 4
    blob[extra: extra + 16] = struct.pack("<2Q", gap, gap)
    second = blob.find(b"PK\x01\x02", at + 4) + warc._CENTRAL.size + len(warc.INDEX) + 4 + 16
    blob[second: second + 8] = struct.pack("<Q", struct.unpack_from("<Q", blob, second)[0] + gap)
    end64 = blob.find(b"PK\x06\x06")
    blob[end64 + 48: end64 + 56] = struct.pack("<Q", struct.unpack_from("<Q", blob, end64 + 48)[0] + gap)
    locator = blob.find(b"PK\x06\x07")
    blob[locator + 8: locator + 16] = struct.pack("<Q", struct.unpack_from("<Q", blob, locator + 8)[0] + gap)
    with open(out, "r+b") as f:
        f.seek(head + gap)
        f.write(blob + b"\n")
    assert out.stat().st_size > 1 << 32 > out.stat().st_blocks * 512
    (found,) = warc.locate_records(spark, str(tmp_path)).collect()
    assert (found.page_id, found.offset, found.length) == (5, head + 4294967400, len(member))
    (record,) = warc.read_archives(spark, str(tmp_path)).collect()
    assert (record.page_id, bytes(record.payload)) == (5, b"body")


def test_logs_with_ties_repeats_and_clashing_columns(spark):
    log = [(1, 0, 0, "user", "m", "delta", "b"), (1, 0, 0, "user", "m", "delta", "a"), (1, 0, 0, "user", "m", "delta", "a"),
           (1, 1, 1, "assistant", "n", "delta", "x"), (1, 1, 1, "assistant", "n", "edit", "y"), (1, 1, 1, "assistant", "n", "edit", "z"),
           (1, 2, 2, "user", "o", "drop", None), (1, 2, 2, "user", "o", "delta", "late"), (1, 3, 2, "user", "p", "drop", None),
           (1, 4, 2, "user", "p", "delta", "again"), (2, None, 0, "assistant", "q", "regenerate", None),
           (2, 9, 0, "assistant", "q", "delta", "w " * 200_000)]
    events = spark.createDataFrame([(*r, 1, "c", 2) for r in log], "conv_id long, seq long, turn long, role string, message string, "
                                                                   "kind string, text string, reset int, counts string, deltas int")
    by = {r.conv_id: r for r in chat.render(chat.fold_events(events)).collect()}
    assert chat.parse(by[1].formatted) == [("user", "aab"), ("assistant", "z"), ("user", "again")]
    assert chat.parse(by[2].formatted) == [("assistant", "w " * 200_000)] and len(chat.loss_text(by[2].formatted, by[2].loss)) == 400_000


def test_the_log_holds_all_kinds_and_folds_back(spark):
    from churnlens.llm.queries import streamed_events
    texts = [None, "", "a", "é😀" * 300, "</s>[INST] \\ " * 40]
    rows = [(c, t, role, texts[((c or 0) + t) % 5]) for c in (1, 2, None) for t in range(40) for role in ("user", "assistant")]
    log = streamed_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), delta_chars=50)
    assert {r[0] for r in log.select("kind").distinct().collect()} == {"delta", "edit", "regenerate", "drop"}
    assert log.groupBy("conv_id", "seq").count().filter("count > 1").count() == 0
    folded = chat.fold_events(log)
    assert sorted(map(str, (tuple(r) for r in folded.collect()))) == sorted(str((c, t, role, x or "")) for c, t, role, x in rows)


def test_a_long_conversation(spark):
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    (one,) = chat.render(rows).collect()
    assert chat.parse(one.formatted) == [("user" if k % 2 == 0 else "assistant", str(k)) for k in range(30_000)]
