"""Hard negatives: rows of another label that score nearly as high as an anchor's positives.

Components are quantised to floor(256 * x); a score is the integer inner
product with the anchor.  An anchor's positives are its best ``POSITIVES``
other rows of its label; a positive's negatives are the best ``NEGATIVES`` rows
of other labels with ``low`` * positive <= 100 * negative <= 100 * positive.
Higher scores come first, then smaller ids.

1. Rows of a label are sorted along a Hilbert curve over the ``CURVE_DIMS`` dimensions of
   the largest variance and cut into Parquet blocks of ``BLOCK_ROWS``; each has
   a zone map, the minimum and maximum of every dimension and of the label.
   Consecutive blocks are a segment, with a zone map of its own: about ``SEGMENTS``
   segments of ``SEGMENT_LEAST`` to ``SEGMENT_MOST`` blocks.
2. A search asks, for each anchor, for the best rows in windows of scores.  The
   anchor's own block is read first: the worst of its best rows that fill a
   window raises the window's lower end.
3. Interval arithmetic bounds the scores of a segment, then of a block, for
   each anchor: sum over the dimensions of the product with whichever end is
   larger (smaller).  Only blocks whose interval meets an open window, and whose
   labels fit, are read; windows rise further while blocks are read.

Each segment goes to one task, with those anchors that may need it streaming
by in chunks, so a task holds one segment (``SEGMENT_MOST * BLOCK_ROWS`` rows at most)
and one chunk of ``CHUNK`` anchors.  Nothing is capped: a block is left out only where no
row of it can be among the results.

Defined results: rows with a NULL label or vector, or any NULL or non-finite
component, take no part, nor do rows with a NULL id; shorter vectors are
padded with zeros; a repeated id is another row (it may be the anchor's
positive); a quantised component beyond 32 bits, or scores beyond 63 bits, fail
the job; without anchors, positives or rows there are no results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.llm.common import Scratch, global_positions
from churnlens.llm.sharding import hilbert_index

POSITIVES = 5
NEGATIVES = 5
LOW = 80
SCALE = 256
CURVE_DIMS = 8
CURVE_BITS = 4
BLOCK_ROWS = 256
SEGMENTS = 256
SEGMENT_LEAST, SEGMENT_MOST = 16, 1024
PAGE = 1024
CHUNK = 512
_SLICE = 4096

_FAR = np.iinfo(np.int64).max
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

_BLOCK = [("segment", pa.int64()), ("block", pa.int64()), ("rows", pa.binary()), ("ids", pa.binary()),
          ("labels", pa.binary()), ("vectors", pa.binary()), ("low", pa.binary()), ("high", pa.binary())]
_BLOCK_DDL = "segment long, block long, rows binary, ids binary, labels binary, vectors binary, low binary, high binary"
_ASK = ["rows", "labels", "vectors", "low", "high"]
_FOUND = [("row", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("id", pa.int64())]
_FOUND_DDL = "row long, window int, score long, id long"


def _ints(blob: bytes, width: int = 0) -> np.ndarray:
    values = np.frombuffer(blob, dtype=np.int64)
    return values.reshape(-1, width) if width else values


def _vectors(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.int32).reshape(-1, width)


def _record(columns: list, fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of two sets of rows."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 1 << 53:  # every partial sum is an integer that a double holds
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top >= _FAR:
        raise OverflowError("scores do not fit 63 bits")
    return a.astype(np.int64) @ b.T.astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each row of ``a`` with any vector of each box [low, high]."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return scores(up, low) + scores(down, high), scores(up, high) + scores(down, low)


def _fits(labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> np.ndarray:
    """Whether boxes with labels in [low, high] may hold a row of the same (another) label."""
    mine = labels[:, None]
    return (low[None, :] <= mine) & (mine <= high[None, :]) if same else (low[None, :] != mine) | (high[None, :] != mine)


class _Best:
    """The best ``k`` rows of each (anchor, window), and the windows' open parts."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray,
                 k: int, same: bool):
        self.rows, self.labels, self.vectors, self.low, self.high = rows, labels, vectors, low.copy(), high
        self._k, self._same = k, same
        self.found = [[np.empty(0, np.int64)] * 3 for _ in range(low.shape[1])]  # anchor, score, id

    def reads(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Anchors by boxes: whether the box must be read (the last column of a box is its label)."""
        least, most = bounds(self.vectors, low[:, :-1], high[:, :-1])
        need = np.zeros(least.shape, dtype=bool)
        for w in range(self.low.shape[1]):
            opened = self.low[:, w] <= self.high[:, w]
            need |= opened[:, None] & (most >= self.low[:, w, None]) & (least <= self.high[:, w, None])
        return need & _fits(self.labels, low[:, -1], high[:, -1], self._same)

    def add(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for begin in range(0, len(rows), _SLICE):
            cut = slice(begin, begin + _SLICE)
            s = scores(self.vectors, vectors[cut])
            fit = (s >= self.low.min(axis=1)[:, None]) & (s <= self.high.max(axis=1)[:, None])
            a, r = np.nonzero(fit)
            r_all = r + begin
            ok = (self.labels[a] == labels[r_all]) == self._same
            ok &= self.rows[a] != rows[r_all]
            a, r_all, s = a[ok], r_all[ok], s[a[ok], r[ok]]
            for w in range(self.low.shape[1]):
                inside = (s >= self.low[a, w]) & (s <= self.high[a, w])
                if inside.any():
                    self._merge(w, a[inside], s[inside], ids[r_all[inside]])

    def _merge(self, w: int, a: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        a, s, i = (np.concatenate(pair) for pair in zip(self.found[w], (a, s, i)))
        order = np.lexsort((i, -s, a))
        a, s, i = a[order], s[order], i[order]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
        full = place == self._k - 1
        self.low[a[full], w] = np.maximum(self.low[a[full], w], s[full])
        keep = place < self._k
        self.found[w] = [a[keep], s[keep], i[keep]]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for w, (a, s, i) in enumerate(self.found):
            yield _record([self.rows[a], np.full(len(a), w, np.int32), s, i], _FOUND)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sum and sum of squares of each dimension over this task's rows."""
    total = np.zeros((3, 0))
    for batch in batches:
        column = batch.column(0)
        sizes = np.diff(column.offsets.to_numpy())
        values = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())).to_numpy().astype(np.float64)
        dims = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        width = max(total.shape[1], int(sizes.max(initial=0)))
        total = np.pad(total, ((0, 0), (0, width - total.shape[1])))
        for row, weights in enumerate((None, values, values * values)):
            total[row] += np.bincount(dims, weights=weights, minlength=width)
    fields = [("dim", pa.int32()), ("n", pa.float64()), ("total", pa.float64()), ("squares", pa.float64())]
    yield _record([np.arange(total.shape[1], dtype=np.int32), *total], fields)


def _pack_blocks(width: int):
    """One row a block, its members sorted by id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, block, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                members = sorted(members.as_py(), key=lambda m: (m["id"], m["row"]))
                vectors = np.zeros((len(members), width), dtype=np.int32)
                for k, m in enumerate(members):
                    vectors[k, : len(m["q"])] = m["q"]
                rows, ids, labels = (np.array([m[c] for m in members], dtype=np.int64) for c in ("row", "id", "label"))
                boxed = np.concatenate([vectors, labels[:, None]], axis=1)
                yield _record([[v] for v in (segment, block, rows.tobytes(), ids.tobytes(), labels.tobytes(), vectors.tobytes(),
                                             boxed.min(axis=0).tobytes(), boxed.max(axis=0).tobytes())], _BLOCK)
    return run


def _zones(width: int, key: str):
    """The box around the boxes of each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, boxes in zip(batch.column(0).to_pylist(), batch.column(1)):
                boxes = boxes.as_py()
                low = np.stack([_ints(b["low"]) for b in boxes]).min(axis=0)
                high = np.stack([_ints(b["high"]) for b in boxes]).max(axis=0)
                yield _record([[group], [low.tobytes()], [high.tobytes()]],
                              [(key, pa.int64()), ("low", pa.binary()), ("high", pa.binary())])
    return run


def _asks(batch: pa.RecordBatch, width: int, windows: int) -> Iterator[tuple]:
    for k in range(batch.num_rows):
        blobs = [batch.column(c)[k].as_py() for c in _ASK]
        yield (_ints(blobs[0]), _ints(blobs[1]), _vectors(blobs[2], width), _ints(blobs[3], windows), _ints(blobs[4], windows))


def _seed(width: int, windows: int, k: int, same: bool):
    """Asks with their windows' lower ends raised by the best rows of the anchor's own block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                asks = batch.column("asks")[n].as_py()
                rows, ids, labels = (_ints(batch.column(c)[n].as_py()) for c in ("rows", "ids", "labels"))
                vectors = _vectors(batch.column("vectors")[n].as_py(), width)
                place = {int(r): at for at, r in enumerate(rows)}
                at = np.array([place[a["row"]] for a in asks])
                low = np.full((len(asks), windows), _FAR)  # an absent window is empty: it begins above its end
                high = np.full((len(asks), windows), -_FAR)
                for m, a in enumerate(asks):
                    low[m, : len(a["low"])], high[m, : len(a["high"])] = a["low"], a["high"]
                best = _Best(rows[at], labels[at], vectors[at], low, high, k, same)
                best.add(rows, ids, labels, vectors)
                yield _record([[v.tobytes()] for v in (best.rows, best.labels, best.vectors, best.low, high)],
                              [(c, pa.binary()) for c in _ASK])
    return run


def _pack_asks(width: int, windows: int):
    """Chunks of up to CHUNK anchors, as they lie along the curve."""
    size = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def chunk() -> pa.RecordBatch:
            parts = [np.concatenate([h[c] for h in held]) for c in range(len(_ASK))]
            return _record([[p.tobytes()] for p in parts], [(c, pa.binary()) for c in _ASK])
        for batch in batches:
            for ask in _asks(batch, width, windows):
                if n and n + len(ask[0]) > size:
                    yield chunk()
                    held, n = [], 0
                held.append(ask)
                n += len(ask[0])
        if held:
            yield chunk()
    return run


def _plan(width: int, windows: int, k: int, same: bool):
    """For each segment of the page, the chunk's anchors that may need it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("segment", pa.int64())] + [(c, pa.binary()) for c in _ASK]
        for batch in batches:
            for n, ask in enumerate(_asks(batch, width, windows)):
                zones = batch.column("zones")[n].as_py()
                low, high = (np.stack([_ints(z[c]) for z in zones]) for c in ("zone_low", "zone_high"))
                need = _Best(*ask, k, same).reads(low, high)
                for z in np.flatnonzero(need.any(axis=0)):
                    picked = need[:, z]
                    yield _record([[zones[z]["segment"]], *[[p[picked].tobytes()] for p in ask]], fields)
    return run


def _scan(width: int, windows: int, k: int, same: bool):
    """Rows sorted by segment, its blocks before its asks: reads the blocks that the bounds leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blocks, boxes = None, [], None
        for batch in batches:
            for n in range(batch.num_rows):
                segment = batch.column("segment")[n].as_py()
                if segment != current:
                    current, blocks, boxes = segment, [], None
                if batch.column("block")[n].is_valid:
                    blobs = [batch.column(c)[n].as_py() for c in ("rows", "ids", "labels", "vectors", "low", "high")]
                    blocks.append([*map(_ints, blobs[:3]), _vectors(blobs[3], width), *map(_ints, blobs[4:])])
                    continue
                if boxes is None:
                    boxes = [np.stack([b[c] for b in blocks]) for c in (4, 5)]
                best = _Best(*next(_asks(batch.slice(n, 1), width, windows)), k, same)
                need = best.reads(*boxes)
                # most wanted blocks first: they close the windows for the others
                for b in np.argsort(-need.sum(axis=0), kind="stable"):
                    if need[:, b].any() and best.reads(boxes[0][b: b + 1], boxes[1][b: b + 1]).any():
                        best.add(*blocks[b][:4])
                yield from best.batches()
    return run


class Candidates:
    """Rows as Hilbert-ordered blocks with zone maps, and searches over them."""

    def __init__(self, scratch: Scratch, rows: DataFrame):
        """``rows``: id, label (long), q (array of long), is_anchor."""
        self._scratch = scratch
        rows = scratch.table(rows, "rows")
        moments = rows.select("q").mapInArrow(_moments, "dim int, n double, total double, squares double") \
            .groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
        spread = moments.withColumn("mean", F.col("total") / F.col("n")) \
            .withColumn("variance", F.greatest(F.col("squares") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0)))
        widest = spread.orderBy(F.desc("variance"), "dim").limit(CURVE_DIMS).collect()  # a row a dimension, at most CURVE_DIMS
        self.width = (moments.agg(F.max("dim")).first()[0] or 0) + 1
        cells = [_cell(F.coalesce(F.get("q", F.lit(d.dim)), F.lit(0)), d.mean, d.variance) for d in widest]
        curve = hilbert_index(cells, CURVE_BITS) if len(cells) > 1 else cells[0] if cells else F.lit(0).cast("bigint")
        placed = global_positions(scratch, scratch.table(rows.withColumn("curve", curve), "curve"),
                                  [F.col("label"), F.col("curve"), F.col("id")], "along_curve", "row")
        block = F.floor(F.col("row") / BLOCK_ROWS).cast("bigint")
        segment_blocks = min(SEGMENT_MOST, max(SEGMENT_LEAST, placed.count() // (SEGMENTS * BLOCK_ROWS)))
        members = placed.groupBy(F.floor(block / segment_blocks).cast("bigint").alias("segment"), block.alias("block")) \
            .agg(F.collect_list(F.struct("row", "id", "label", "q")).alias("members"))  # BLOCK_ROWS at most
        self.blocks = scratch.table(members.mapInArrow(_pack_blocks(self.width), _BLOCK_DDL), "blocks")
        segments = self.blocks.groupBy("segment").agg(F.collect_list(F.struct("low", "high")).alias("boxes")) \
            .mapInArrow(_zones(self.width, "segment"), "segment long, low binary, high binary")
        page = F.floor(F.col("segment") / PAGE).cast("int")
        self._pages = scratch.table(segments.groupBy(page.alias("page")).agg(F.collect_list(F.struct(
            "segment", F.col("low").alias("zone_low"), F.col("high").alias("zone_high"))).alias("zones")), "pages")
        self._n_pages = (self._pages.agg(F.max("page")).first()[0] or 0) + 1
        self.anchors = scratch.table(placed.filter("is_anchor").select("row", "id"), "anchors")

    def search(self, asks: DataFrame, windows: int, k: int, same: bool, name: str) -> DataFrame:
        """(row, window, score, id, rank) of the best ``k`` rows in each window.

        ``asks``: row and the arrays low and high, inclusive ends of up to ``windows`` windows.
        """
        how = (self.width, windows, k, same)
        packed = ", ".join(f"{c} binary" for c in _ASK)
        block = F.floor(F.col("row") / BLOCK_ROWS).cast("bigint")
        own = asks.groupBy(block.alias("own")).agg(F.collect_list(F.struct("row", "low", "high")).alias("asks"))
        home = self.blocks.drop("low", "high").join(own, F.col("block") == F.col("own"))
        seeded = home.repartitionByRange("block").sortWithinPartitions("block") \
            .select("rows", "ids", "labels", "vectors", "asks").mapInArrow(_seed(*how), packed)
        chunks = self._scratch.table(seeded.mapInArrow(_pack_asks(self.width, windows), packed), f"{name}_chunks")
        # every chunk meets every page of zone maps: the stated anchors against all rows, in blocks of blocks
        paged = chunks.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(self._n_pages - 1))))
        needs = paged.join(self._pages, F.col("number") == F.col("page")).select(*_ASK, "zones") \
            .mapInArrow(_plan(*how), f"segment long, {packed}")
        needs = self._scratch.table(needs, f"{name}_needs")
        both = self.blocks.unionByName(needs, allowMissingColumns=True)
        found = both.repartition("segment").sortWithinPartitions("segment", F.col("block").asc_nulls_last()) \
            .mapInArrow(_scan(*how), _FOUND_DDL)
        order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id")
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return self._scratch.table(best, f"{name}_best")


def _cell(value: Column, mean: float, variance: float) -> Column:
    """The value's cell within two standard deviations of the mean, clipped."""
    deviation = max(variance ** 0.5, 1e-9)
    return F.greatest(F.lit(0), F.least(F.lit(2 ** CURVE_BITS - 1), F.floor(
        (value - F.lit(mean - 2 * deviation)) * F.lit(2 ** CURVE_BITS / (4 * deviation))))).cast("bigint")


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component; NULL where the vector or a component is NULL or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * SCALE
        return F.when(F.abs(scaled) < 2.0 ** 31 - 1, F.floor(scaled)).otherwise(
            F.raise_error(F.lit("a quantised component does not fit 32 bits")).cast("bigint"))
    return F.when(vector.isNotNull() & sound, F.transform(vector, whole))


def mine(scratch: Scratch, rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", low: int = LOW) -> DataFrame:
    """One row for each (anchor, positive, negative); ``is_anchor`` is a condition on ``rows``."""
    taking = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                         quantised(F.col(f"`{vector_col}`")).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    candidates = Candidates(scratch, taking.filter("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL"))
    everything = candidates.anchors.select("row", F.array(F.lit(-int(_FAR))).alias("low"), F.array(F.lit(int(_FAR))).alias("high"))
    positives = candidates.search(everything, 1, POSITIVES, True, "positives")
    pairs = positives.select("row", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"),
                             F.col("score").alias("positive_score"))
    # 80 p <= 100 n: the least n is the ceiling of 80 p / 100
    least = -F.expr(f"((-{low} * positive_score) - pmod(-{low} * positive_score, 100)) div 100")
    listed = pairs.withColumn("least", least).groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("window", "least", "positive_score"))).alias("windows"))
    asks = listed.select("row", F.col("windows.least").alias("low"), F.col("windows.positive_score").alias("high"))
    negatives = candidates.search(asks, POSITIVES, NEGATIVES, False, "negatives")
    found = negatives.select(F.col("row").alias("of_row"), F.col("window").alias("of_window"), "rank",
                             F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(found, (F.col("row") == F.col("of_row")) & (F.col("window") == F.col("of_window"))) \
        .join(candidates.anchors.withColumnRenamed("row", "anchor_row").withColumnRenamed("id", "anchor_id"),
              F.col("row") == F.col("anchor_row"))
    return scratch.publish(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                                      "positive_score", "negative_score"), "negatives")
