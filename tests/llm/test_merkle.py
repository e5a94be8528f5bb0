"""The Merkle manifest against a plain tree: odd runs, several bands, NULLs, ties, empty tables."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from churnlens.llm import merkle
from churnlens.llm.common import Scratch
from churnlens.llm.queries import QUERIES
from tests.conftest import SF_SMALL

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, merkle int, run int, slot int, node string, row int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """(last node, sibling steps of each leaf)."""
    steps, above, owner = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(above) > 1:
        for k in range(len(nodes)):
            at = owner[k]
            other = at ^ 1
            steps[k].append((at % 2, above[other]) if other < len(above) else (2, ""))
            owner[k] = at // 2
        above = [H(*above[k: k + 2]) for k in range(0, len(above), 2)]
    return above[0], steps


def plain(rows):
    """(doc_id, leaf, subroot, root, steps) of rows (doc_id, source, lang, n_chars, text)."""
    runs = {}
    for r in rows:
        runs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    ordered = sorted(runs, key=lambda v: (v is not None, (v or "").encode()))
    built = []
    for value in ordered:
        members = sorted(runs[value], key=lambda m: m[:3])
        built.append((members, *tree([m[2] for m in members])))
    root, upper = tree([b[1] for b in built]) if built else (None, [])
    return sorted((str(m[3][0]), m[2], sub, root, steps + up) for (members, sub, all_steps), up in zip(built, upper)
                  for m, steps in zip(members, all_steps))


def got(scratch, docs):
    rows = merkle.manifest(scratch, docs, FIELDS)
    name = rows.columns[-1]
    assert rows.columns[:-1] == docs.columns
    return sorted((str(r[0]), r[1].leaf, r[1].subroot, r[1].root, [(s.side, s.sibling) for s in r[1].steps])
                  for r in rows.select("doc_id", name).collect())


def rows_of(counts, **extra):
    return [(k, f"s{k % 3}", lang, k, f"text {k} é") for lang, n in counts.items() for k in range(n)]


@pytest.mark.parametrize("band", [1, 2, 10])
def test_runs_of_every_small_length(spark, monkeypatch, band):
    monkeypatch.setattr(merkle, "BAND", band)
    rows = rows_of({None: 1, "": 2, "a": 3, "b": 7, "B": 8, "é": 13, "zz": 33})
    docs = spark.createDataFrame([(*r, 1, 2, 3, "n", 4) for r in rows], SCHEMA)
    with Scratch(spark, "merkle") as scratch:
        assert got(scratch, docs) == plain(rows)


def test_nulls_ties_repeats_long_texts(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "a", "en", 3, "x"), (1, "a", "en", 4, "x"),
            (1, "a", "en", 3, "x"), (2, None, "en", None, ""), (3, "b", "en", 1, "w " * 200_000), (-4, "-", "en", 0, "😀\n")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "n", 4) for r in rows], SCHEMA)
    with Scratch(spark, "merkle") as scratch:
        assert got(scratch, docs) == plain(rows)


def test_no_rows_and_one_row(spark):
    docs = spark.createDataFrame([(7, "s", "en", 1, "t", 1, 2, 3, "n", 4)], SCHEMA)
    with Scratch(spark, "merkle") as scratch:
        assert merkle.manifest(scratch, docs.filter("false"), FIELDS).count() == 0
    with Scratch(spark, "merkle") as scratch:
        only = merkle.manifest(scratch, docs, FIELDS).select("merkle_1.*").first()
    assert only.leaf == only.subroot == only.root and only.steps == []


def test_proofs_fold_to_the_root_and_tampering_shows(spark):
    rows = rows_of({"a": 11, "b": 5, "c": 1})
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    with Scratch(spark, "merkle") as scratch:
        out = merkle.manifest(scratch, docs, FIELDS)
        folded = out.select(
            (merkle.fold(F.col("merkle.leaf"), F.col("merkle.steps")) == F.col("merkle.root")).alias("sound"),
            (merkle.fold(F.sha2("merkle.leaf", 256), F.col("merkle.steps")) == F.col("merkle.root")).alias("forged")).collect()
    assert all(r.sound and not r.forged for r in folded)


def test_windows_are_partitioned(spark):
    """No window over a whole run: a language with most rows is spread over its chunks."""
    nodes = spark.range(5000).select(F.floor(F.col("id") / 5000).alias("run"), F.col("id").alias("slot"), F.lit(5000).alias("n"),
                                     F.sha2(F.col("id").cast("string"), 256).alias("node"))
    plan = merkle._band(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(run" in plan and "chunk" in plan and "SinglePartition" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_query_against_plain_tree(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*FIELDS).collect()]
    expected, number = {}, {str(d[0]): d for d in docs}
    for i, own, sub, root, steps in plain(docs):
        d = number[i]
        changed = zlib.crc32(i.encode()) % 7 == 0 and d[3] is not None
        node = leaf((*d[:3], d[3] + 1, d[4])) if changed else own
        for side, sibling in steps:
            node = H(node, sibling) if side == 0 else H(sibling, node) if side == 1 else H(node)
        expected[d[0]] = (d[0], own, sub, root, H(*[s for side, s in steps if side != 2]), node, node == root)
    rows = [tuple(r) for r in QUERIES["op12_merkle"](spark, SF_SMALL).collect()]
    assert sorted(rows) == sorted(expected.values()) and not all(r[6] for r in rows)
