"""Hard negatives against a plain version: ties, negative scores, odd rows, small blocks, empty tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import hardneg
from churnlens.llm.common import Scratch
from churnlens.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, row int, score long, block string"


def plain(rows, is_anchor):
    taking = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        taking.append((i, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for a, (i, q, label) in enumerate(taking):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), j, other != label) for b, (j, p, other) in enumerate(taking) if b != a)
        for positive, j, _ in [s for s in scored if not s[2]][:5]:
            fit = [s for s in scored if s[2] and 80 * -positive <= 100 * -s[0] <= 100 * -positive]
            out += [(i, j, n, s[1], -positive, -s[0]) for n, s in enumerate(fit[:5], 1)]
    return sorted(out)


def mined(spark, rows, is_anchor, data=None):
    df = spark.createDataFrame([(*r, 1, 2, "b") for r in rows], SCHEMA) if data is None else data
    with Scratch(spark, "hardneg") as scratch:
        return sorted(tuple(r) for r in hardneg.mine(scratch, df, is_anchor).collect())


@pytest.fixture()
def small_blocks(monkeypatch):
    for name, value in (("BLOCK_ROWS", 8), ("SEGMENT_LEAST", 2), ("SEGMENTS", 4), ("PAGE", 2), ("CHUNK", 3)):
        monkeypatch.setattr(hardneg, name, value)


def test_clustered_rows_with_ties(spark, small_blocks):
    draw = random.Random(5)
    centres = [[draw.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(300):
        c = draw.randrange(4)
        # coarse values, so that scores tie; some labels disagree with their cluster
        vector = [round(x * 8 + draw.uniform(-2, 2)) / 8 for x in centres[c]]
        rows.append((i, vector, c if draw.random() < 0.7 else draw.randrange(4)))
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == plain(rows, lambda i: i % 10 == 0)


def test_copies_of_one_vector(spark, small_blocks):
    rows = [(i, [0.5, 0.25], i % 3) for i in range(120)] + [(200 + i, [0.5, 0.2], 1) for i in range(40)]
    assert mined(spark, rows, F.col("vec_id") % 40 == 0) == plain(rows, lambda i: i % 40 == 0)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0], 1), (2, [0.9, 0.4, 0.3], 2), (3, None, 1), (4, [None, 1.0], 2), (5, [float("nan"), 1.0], 2),
            (6, [float("inf"), 1.0], 1), (7, [1.0, 0.5], None), (None, [1.0, 0.5], 2), (8, [], 1), (9, [], 2), (0, [0.9, 0.5], 1),
            (10, [-1.0, -0.5], 1), (11, [-1.0, -0.5], 2), (12, [0.9, 0.4, 0.3], 2), (2, [0.9, 0.4, 0.3], 2)]
    # an id that repeats is another row: it may be its copy's positive, and both are anchors
    assert mined(spark, rows, F.col("vec_id").isin(0, 10, 8)) == plain(rows, lambda i: i in (0, 10, 8))


def test_nothing_to_mine(spark):
    rows = [(0, [1.0], 1), (1, [1.0], 1)]
    df = spark.createDataFrame([(*r, 1, 2, "b") for r in rows], SCHEMA)
    assert mined(spark, rows, F.lit(True)) == []  # no other label
    assert mined(spark, rows, F.lit(False)) == [] and mined(spark, rows, F.lit(None).cast("boolean")) == []
    assert mined(spark, rows, F.lit(True), df.filter("false")) == []


def test_components_beyond_the_range_fail(spark):
    with pytest.raises(Exception, match="32 bits"):
        mined(spark, [(0, [1e30], 1)], F.lit(True))


def test_bounds_hold_every_row():
    draw = np.random.default_rng(3)
    for _ in range(50):
        a, rows = draw.integers(-300, 300, (5, 7)), draw.integers(-300, 300, (9, 7))
        least, most = hardneg.bounds(a, rows.min(axis=0)[None, :], rows.max(axis=0)[None, :])
        s = hardneg.scores(a, rows)
        assert (s == a @ rows.T).all()
        assert (least <= s.min(axis=1, keepdims=True)).all() and (s.max(axis=1, keepdims=True) <= most).all()


def test_large_scores_stay_exact():
    a = np.array([[2 ** 30, 3]], dtype=np.int32)
    assert hardneg.scores(a, a)[0, 0] == 2 ** 60 + 9
    with pytest.raises(OverflowError):
        hardneg.scores(np.repeat(a, 4, axis=1) * 1, np.repeat(a, 4, axis=1))


def test_blocks_out_of_reach_are_not_read():
    """Zone maps of far clusters close the search: only the anchor's own cluster is needed."""
    near = np.array([[100, 0, 1]])  # the last column of a box is its label
    far = np.array([[-100, 0, 1]])
    best = hardneg._Best(np.array([0]), np.array([1]), np.array([[100, 0]]), np.array([[5000]]), np.array([[2 ** 62]]), 5, True)
    assert best.reads(np.concatenate([near, far]), np.concatenate([near + [[5, 5, 0]], far + [[5, 5, 0]]])).tolist() == [[True, False]]
    other = hardneg._Best(np.array([0]), np.array([1]), np.array([[100, 0]]), np.array([[5000]]), np.array([[2 ** 62]]), 5, False)
    assert not other.reads(near, near).any()  # a block of the anchor's own label has no negatives


def test_query_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    got = sorted(tuple(r) for r in QUERIES["op13_hardneg"](spark, SF_SMALL).collect())
    assert got == plain(rows, lambda i: i % 100 == 0)
