"""Near-duplicate groups by an LSH forest over MinHash signatures.

A document's set are its distinct shingles of ``words`` lower-cased words
(fewer words: the whole sequence).  Documents with a similarity (Jaccard) of
at least ``percent``/100 are linked; groups are connected components.

1. Sketch: set size, digest of the set, MinHash values: ``COORDINATES`` whole ones
   for the trees and ``EXTRA`` further ones of a byte each.  Equal sets become one node.
2. Forest: ``TREES`` sorted orders of the signatures, each beginning with
   other coordinates.  Nodes that share their first ``DEPTH`` coordinates form
   a region, a run of the order; a true link falls into a common region of some tree
   but for (1 - s ** DEPTH) ** TREES, 2e-9 at s = 0.85.
3. A node's candidate is its neighbour in the order, the one with the longest
   common prefix: within a region, the nearest predecessor of *another* component.
   The first ``FIRST_TREES`` trees alone join most copies; with their components
   contracted, all trees follow, and once more what they left apart.
4. Depth adapts to the region: one of up to ``NEAR`` + 1 nodes needs no more than
   its first ``DEPTH`` coordinates, every pair of it is compared; in larger ones the
   deeper coordinates decide who is near.
5. Larger regions that hold several components even then are finished by an
   exact prefix join: two linked sets share one of their rarest shingles, and enough
   shingles follow it in both, so only such sets of different components are
   compared.

Pairs that set sizes rule out, or that share so few signature values as a
linked pair does once in 1e9 cases, are dropped; all others are confirmed on
the full sets, each pair once.  No group or bucket is capped, and no pairs are made
within a component.

Defined results: NULL text, or text without words, has an empty set and is
linked with nothing (its component is its id); repeated ids are separate documents
if their sets differ; rows with a NULL id belong to the group of their text, a group
of NULL ids alone has a NULL component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.llm.common import Scratch, fresh, strip_space
from churnlens.llm.components import components
from churnlens.llm.hashing import mix, word_hashes

WORDS = 5
PERCENT = 80
COORDINATES = 64
EXTRA = 192
TREES = 21
DEPTH = 3
KEY = 6  # coordinates of a sort key
FIRST_TREES = 4
NEAR = 8
_CHUNK = 256
_SIGNATURE_BYTES = 4 * COORDINATES + EXTRA

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
               0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    hashes = word_hashes(tokens)
    width = min(words, len(tokens))
    n = len(hashes) - width + 1
    acc = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        acc = mix(acc * _C[k % len(_C)] + hashes[k: k + n])
    return np.unique(acc)


_DRAWN = mix(np.arange(1, 2 * (COORDINATES + EXTRA) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = (_DRAWN[: COORDINATES + EXTRA] | np.uint64(1))[:, None], _DRAWN[COORDINATES + EXTRA:][:, None]


def signature(shingles: np.ndarray) -> bytes:
    """MinHash values: the upper 32 bits of the minima for the trees, a byte of the others."""
    low = np.full(COORDINATES + EXTRA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), _CHUNK):
        np.minimum(low, (_A * shingles[None, i: i + _CHUNK] + _B).min(axis=1), out=low)
    return (low[:COORDINATES] >> np.uint64(32)).astype(">u4").tobytes() + (low[COORDINATES:] >> np.uint64(32)).astype(np.uint8).tobytes()


def _batch(columns: list, fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _sketch(words: int):
    fields = [("id", pa.int64()), ("text_md5", pa.string()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, md5, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingle_set(text.as_py(), words)
                rows.append((i, md5, len(s), xxhash.xxh128_digest(s.tobytes()) if len(s) else None,
                             signature(s) if len(s) else None))
            yield _batch(list(zip(*rows)) or [[]] * len(fields), fields)
    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a tree: its number, the node's place in its order, and the node."""
    fields = [("tree", pa.int32()), ("key", pa.binary()), ("node", pa.int64())]
    for batch in batches:
        for begin in range(0, batch.num_rows, 5000):
            part = batch.slice(begin, 5000)
            coordinates = _signatures(part.column(1))[0]
            for t in range(TREES):
                key = np.ascontiguousarray(coordinates[:, [(t * DEPTH + k) % COORDINATES for k in range(KEY)]])
                yield _batch([np.full(len(key), t, np.int32), [row.tobytes() for row in key], part.column(0)], fields)


def _sets(words: int):
    fields = [("node", pa.int64()), ("shingles", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                yield _batch([part.column(0), [shingle_set(t.as_py(), words).tobytes() for t in part.column(1)]], fields)
    return run


def _confirm(percent: int):
    fields = [("a", pa.int64()), ("b", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(k) for k in range(4))
            good = []
            for i in range(batch.num_rows):
                x = np.frombuffer(left[i].as_py(), dtype=np.uint64)
                y = np.frombuffer(right[i].as_py(), dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], [n for n, _ in fields])
    return run


def least_agreement(percent: int) -> int:
    """Signature values that a linked pair shares at least: 6.5 standard deviations below the mean (1e-9)."""
    s, n = percent / 100, COORDINATES + EXTRA
    return max(0, int(n * s - 6.5 * (n * s * (1 - s)) ** 0.5))


def _signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, _SIGNATURE_BYTES)
    return np.ascontiguousarray(whole[:, : 4 * COORDINATES]).view(">u4"), whole[:, 4 * COORDINATES:]


def _plausible(n_a: np.ndarray, n_b: np.ndarray, sig_a: tuple, sig_b: tuple, percent: int) -> np.ndarray:
    """Pairs whose set sizes and signatures allow a link."""
    sizes = np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * percent
    agreement = sum((x == y).sum(axis=1) for x, y in zip(sig_a, sig_b))
    return sizes & (agreement >= least_agreement(percent))


def _plausible_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, dtype=bool)
            if batch.num_rows:
                good = _plausible(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(),
                                  _signatures(batch.column("sig_a")), _signatures(batch.column("sig_b")), percent)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])
    return run


def _neighbours(percent: int):
    """Plausible candidates of rows in the trees' orders (region, node, part, small, n, sig).

    In a small region every row of another component before a row is its
    candidate, in others the nearest one.
    """
    pair = [("a", pa.int64()), ("b", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows before this batch that may still be somebody's candidate
        region = None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("region", "node", "part", "small", "n", "sig"))))
            left, right = [], []
            for row in rows:
                if row[0] != region:
                    region, held = row[0], []
                before = [h for h in held if h[2] != row[2]]
                if before:
                    chosen = before if row[3] else before[-1:]
                    left.extend([row] * len(chosen))
                    right.extend(chosen)
                if row[3]:
                    held.append(row)
                else:  # the last row, and the last one of another component than its
                    held = [h for h in held if h[2] != row[2]][-1:] + [row]
            for begin in range(0, len(left), 4096):
                x, y = left[begin: begin + 4096], right[begin: begin + 4096]
                sizes = [np.array([r[4] for r in side]) for side in (x, y)]
                sigs = [_signatures(pa.array([r[5] for r in side], pa.binary())) for side in (x, y)]
                good = np.flatnonzero(_plausible(*sizes, *sigs, percent))
                yield _batch([[x[i][1] for i in good], [y[i][1] for i in good]], pair)
    return run


def _first_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, predecessor) of rows in the trees' orders (region, node)."""
    last = (None, None)
    for batch in batches:
        rows = [last, *zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        pairs = [(b[1], a[1]) for a, b in zip(rows, rows[1:]) if a[0] == b[0]]
        last = rows[-1]
        yield _batch(list(zip(*pairs)) or [[], []], [("a", pa.int64()), ("b", pa.int64())])


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("node", pa.int64()), ("shingle", pa.int64())]
    for batch in batches:
        for node, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.frombuffer(blob.as_py(), dtype=np.int64)
            yield _batch([np.full(len(values), node), values], fields)


class _Comparer:
    """Confirms pairs on the full sets of their nodes, each pair once."""

    def __init__(self, scratch: Scratch, known: DataFrame, sets: DataFrame, percent: int):
        self._scratch, self._known, self._sets, self._percent = scratch, known, sets, percent
        self._tested: list[DataFrame] = []

    def links(self, pairs: DataFrame, name: str, plausible: bool = False) -> DataFrame:
        """The linked ones of ``pairs``; ``plausible``: sizes and signatures were looked at already."""
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        if not plausible:
            sides = [self._known.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
                     for x in ("a", "b")]
            pairs = pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_plausible_pairs(self._percent), "a long, b long")
        if self._tested:
            pairs = pairs.join(reduce(DataFrame.union, self._tested), ["a", "b"], "left_anti")
        pairs = self._scratch.table(pairs, f"{name}_pairs")
        self._tested.append(pairs)
        left = self._sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
        right = self._sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        return self._scratch.table(both.mapInArrow(_confirm(self._percent), "a long, b long"), f"{name}_links")


def _labelled(rows: DataFrame, stars: DataFrame) -> DataFrame:
    labels = stars.select(F.col("hi").alias("label_node"), F.col("lo").alias("label"))
    return rows.join(labels, F.col("node") == F.col("label_node"), "left") \
        .withColumn("part", F.coalesce("label", "node")).drop("label", "label_node")


def _mixed(scratch: Scratch, members: DataFrame, stars: DataFrame, name: str) -> DataFrame:
    """Members, with their components, of the regions that hold several components."""
    rows = _labelled(members, stars)
    ends = rows.groupBy("region").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("region")
    ends = scratch.table(ends, f"{name}_regions")
    return scratch.table(rows.join(ends, "region", "left_semi"), name)


def _in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in the trees' orders; small regions stay whole, large ones may be cut between tasks."""
    order = [F.col("region"), F.when(~F.col("small"), F.col("key")), F.when(~F.col("small"), F.col("node"))]
    return rows.repartitionByRange(*order).sortWithinPartitions("region", "key", "node").select(*columns)


def near_duplicates(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: id (a long), text_md5, n_shingles, component_id, keeper.

    ``component_id`` is the smallest id of the group; ``keeper`` marks the rows of
    the one document that stands for it, the smallest in (id, text_md5).
    """
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.md5(text.cast("binary")).alias("text_md5"),
                        text.alias("text"))
    sketch = scratch.table(texts.mapInArrow(
        _sketch(words), "id long, text_md5 string, n long, digest binary, sig binary"), "sketch")

    # equal sets are one node; its number is its place in the written table
    nodes = sketch.filter("digest IS NOT NULL").groupBy("digest").agg(
        _first_document(F.struct("id", "text_md5")), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    forest = scratch.table(nodes.select("node", "sig").mapInArrow(_trees, "tree int, key binary, node long").select(
        "tree", F.concat(F.to_binary(F.lpad(F.hex("tree"), 2, "0"), F.lit("hex")), F.substring("key", 1, 4 * DEPTH)).alias("region"),
        "key", "node"), "forest")
    regions = forest.groupBy("region").agg(F.count(F.lit(1)).alias("n_members")).filter("n_members > 1") \
        .select("region", (F.col("n_members") <= NEAR + 1).alias("small"))
    regions = scratch.table(regions, "regions")  # plain shuffles on both sides of the join: hot regions are split
    crowded = scratch.table(forest.join(regions, "region"), "crowded")
    scratch.drop("forest")

    needed = crowded.select("node").distinct()
    known = scratch.table(nodes.join(needed, "node", "left_semi").select("node", "n", "first", "sig"), "known")
    # the text of its first document stands for a node
    first = known.select("node", F.col("first.id").alias("of_id"), F.col("first.text_md5").alias("of_md5"))
    holders = texts.join(first, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_md5") == F.col("of_md5"))).select("node", "text")
    sets = holders.mapInArrow(_sets(words), "node long, shingles binary")
    sets = scratch.table(sets.groupBy("node").agg(F.any_value("shingles").alias("shingles")), "sets")
    compare = _Comparer(scratch, known, sets, percent)

    early = _in_order(crowded.filter(F.col("tree") < FIRST_TREES), "region", "node").mapInArrow(
        _first_neighbours, "a long, b long")
    links = compare.links(early, "first")
    left = crowded.drop("tree")
    for turn in ("second", "third"):
        parts = components(scratch, links, f"{turn}_parts")
        left = _mixed(scratch, left, parts, f"{turn}_mixed")
        # every pair of a small region is compared in the second turn
        rows = left if turn == "second" else left.filter("NOT small")
        rows = rows.join(known.select("node", "n", "sig"), "node")
        near = _in_order(rows, "region", "node", "part", "small", "n", "sig").mapInArrow(_neighbours(percent), "a long, b long")
        links = links.union(compare.links(near, turn, plausible=True))
        left = left.filter("NOT small").drop("part")
    parts = components(scratch, links, "joined")
    rest = scratch.table(_mixed(scratch, left, parts, "still_mixed").select("node", "part").distinct(), "rest")
    links = links.union(compare.links(_prefix_pairs(scratch, rest, sets, percent), "rest"))

    stars = components(scratch, links, "groups")
    numbered = nodes.select("digest", "node").join(stars, F.col("node") == F.col("hi"), "left") \
        .select(F.col("digest").alias("set"), F.coalesce("lo", "node").alias("part"))
    numbered = scratch.table(numbered, "numbered")
    # the smallest document of each component, copies pre-aggregated by their set
    firsts = sketch.filter("digest IS NOT NULL").groupBy("digest").agg(_first_document(F.struct("id", "text_md5"))) \
        .join(numbered, F.col("digest") == F.col("set")).groupBy("part").agg(_first_document(F.col("first")))
    firsts = scratch.table(firsts.select(F.col("part").alias("of_part"), "first"), "firsts")
    placed = sketch.join(numbered, F.col("digest") == F.col("set"), "left").join(firsts, F.col("part") == F.col("of_part"), "left")
    first = F.col("first")
    keeper = F.col("digest").isNull() | (F.col("id").eqNullSafe(first["id"]) & (F.col("text_md5") == first["text_md5"]))
    return scratch.publish(placed.select(
        "id", "text_md5", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(first["id"])
        .alias("component_id"), keeper.alias("keeper")), "groups")


def _first_document(document: Column) -> Column:
    """The smallest (id, text_md5), NULL ids last."""
    return F.min(F.struct(document["id"].isNull().alias("unnamed"), document["id"].alias("id"),
                          document["text_md5"].alias("text_md5"))).alias("first")


def _prefix_pairs(scratch: Scratch, rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a shingle among each one's rarest.

    Sets of similarity ``percent``/100 share more shingles than a set of n has
    outside its n - ceil(n * percent / 100) + 1 rarest, so they meet there.
    """
    shingles = sets.join(rest.select("node").distinct(), "node", "left_semi") \
        .mapInArrow(_explode_sets, "node long, shingle long").distinct()
    counted = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_sets"))
    ranked = shingles.join(counted, "shingle")
    by_rarity = Window.partitionBy("node").orderBy("n_sets", "shingle")
    every = Window.partitionBy("node")
    prefix = ranked.withColumn("place", F.row_number().over(by_rarity)) \
        .withColumn("n_all", F.count(F.lit(1)).over(every)) \
        .filter(F.col("place") <= F.col("n_all") - F.ceil(F.col("n_all") * percent / 100) + 1) \
        .filter("n_sets > 1").select("node", "shingle", "n_all", (F.col("n_all") - F.col("place") + 1).alias("to_come"))
    prefix = prefix.join(rest, "node")
    meeting = prefix.groupBy("shingle").agg(F.min("part").alias("p"), F.max("part").alias("q")) \
        .filter("p <> q").select("shingle")
    prefix = scratch.table(prefix.join(meeting, "shingle", "left_semi"), "prefix")
    sides = [prefix.select("shingle", F.col("node").alias(x), F.col("part").alias(f"part_{x}"),
                           F.col("n_all").alias(f"n_{x}"), F.col("to_come").alias(f"to_come_{x}")) for x in ("a", "b")]
    # from their first common shingle on, two linked sets have enough shingles left for the overlap they need
    overlap = (F.col("n_a") + F.col("n_b")) * percent
    return sides[0].join(sides[1], "shingle").filter(
        (F.col("part_a") < F.col("part_b"))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        & (F.least("to_come_a", "to_come_b") * (100 + percent) >= overlap)).select("a", "b")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group: one document each, and every row without words.

    Documents are told apart by id and text, so a repeated id loses no other
    text; of rows equal in both, one stays.
    """
    kept_id, kept_md5, md5 = (fresh(docs.columns, n) for n in ("kept_id", "kept_md5", "text_md5"))
    kept = groups.filter("keeper AND n_shingles > 0").select(F.col("id").alias(kept_id), F.col("text_md5").alias(kept_md5)).distinct()
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(md5) == F.col(kept_md5))
    found = docs.withColumn(md5, F.md5(text.cast("binary"))).join(kept, same).dropDuplicates([id_col, md5])
    wordless = F.coalesce(strip_space(text), F.lit("")) == ""
    return found.filter(~wordless).select(*docs.columns).union(docs.filter(wordless))
