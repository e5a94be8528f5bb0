"""Sharding along a Hilbert curve over metadata dimensions.

Dimensions: source, language and text size, each quantised to ``BITS`` bits.
A categorical dimension is cut by cumulative share of rows in code-point order
(a hot value spans a wide cell of its own, rare ones share cells); size by its
binary exponent and three mantissa bits.  Rows are sorted by their cell's
index on the curve, so a run of neighbours is narrow in every dimension at
once and a file's min/max statistics prune on any of them.  Shards are runs of
equal row counts (law ``rows``: counts differ by one at most); equal texts lie
together within a cell (checksum order).

The global position comes from one range shuffle, so a hot cell is split over
tasks.  Defined results: NULL text has no bytes (size 1, checksum 0), NULL
categories form the last value, repeated rows keep separate slots, NULL ids
sort last, an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.llm.common import Scratch, fresh, global_positions

BITS = 8
SHARDS = 8


def _xor(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), cols)


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of the cell ``axes`` (each 0 .. 2**bits - 1).

    From the highest bit down, an axis with the bit set inverts the lower bits
    of the first axis, otherwise the two axes exchange their lower bits; then
    the axes are Gray-coded and their bits interleaved.  A fold over an array
    column, so all of it stays a built-in expression.
    """
    n = len(axes)

    def turn(x: Column, k: Column) -> Column:
        q = F.pow(F.lit(2), F.lit(bits - 1) - F.floor(k / n)).cast("bigint")
        i = (k % n).cast("int")
        is_set = F.get(x, i).bitwiseAND(q) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, i)).bitwiseAND(q - 1)
        first = F.when(is_set, F.get(x, F.lit(0)).bitwiseXOR(q - 1)).otherwise(F.get(x, F.lit(0)).bitwiseXOR(swap))
        return F.transform(x, lambda v, j: F.when(j == 0, first).when(
            (j == i) & ~is_set, v.bitwiseXOR(swap)).otherwise(v))

    def interleave(x: Column) -> Column:
        coded = [_xor([F.get(x, F.lit(j)) for j in range(i + 1)]) for i in range(n)]
        flip = _xor([F.shiftright(coded[-1], s) for s in range(1, bits)])
        planes = F.array(*[c.bitwiseXOR(flip) for c in coded])
        return F.get(F.transform(F.array(planes), lambda y: reduce(lambda a, b: a + b, [
            F.shiftleft(F.shiftright(F.get(y, F.lit(i)), b).bitwiseAND(1), b * n + n - 1 - i)
            for b in range(bits) for i in range(n)])), F.lit(0))

    steps = F.sequence(F.lit(0), F.lit((bits - 1) * n - 1))
    return F.aggregate(steps, F.array(*[a.cast("bigint") for a in axes]), turn, interleave)


def size_level(size: Column, bits: int = BITS) -> Column:
    """Logarithmic level of a positive size: eight levels to the doubling, integers only."""
    exponent = F.length(F.bin(size)) - 1
    mantissa = F.floor(size.cast("bigint") * 8 / F.pow(F.lit(2.0), exponent)).cast("bigint") % 8
    return F.least(exponent * 8 + mantissa, F.lit(2 ** bits - 1)).cast("bigint")


def share_cells(df: DataFrame, col: str, bits: int = BITS) -> DataFrame:
    """(col, cell) for each distinct value: its place in the cumulative share of rows.

    One row a distinct value; NULL comes last.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
    before = Window.orderBy(F.col(col).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n_rows").over(Window.partitionBy())
    cell = F.floor(F.coalesce(F.sum("n_rows").over(before), F.lit(0)) * 2 ** bits / total).cast("bigint")
    return counts.select(F.col(col).alias(f"{col}_value"), cell.alias(f"{col}_cell"))


def shard(scratch: Scratch, docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with their shard and slot, in the struct ``shard`` (or a free name).

    ``carry`` lists the columns kept (all by default).  The struct holds
    size, text_crc32, curve (Hilbert index), shard and slot (gapless from 0
    within the shard).
    """
    carry = list(docs.columns) if carry is None else carry
    name = fresh(docs.columns, "shard")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("source"),
        F.col(f"`{lang_col}`").alias("lang"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
    )
    slim = docs.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{lang_col}`").alias("lang"))
    # one row a distinct value, written first: its known size lets Spark choose the join
    sources = scratch.table(share_cells(slim, "source"), "source_cells")
    langs = scratch.table(share_cells(slim, "lang"), "lang_cells")
    celled = (
        keyed.join(sources, F.col("source").eqNullSafe(F.col("source_value")))
        .join(langs, F.col("lang").eqNullSafe(F.col("lang_value")))
        .withColumn("curve", hilbert_index([F.col("source_cell"), F.col("lang_cell"), size_level(F.col("size"))]))
        .select("row", "id", "size", "crc", "curve")
    )
    placed = global_positions(
        scratch, celled, [F.col("curve"), F.col("crc"), F.col("id").asc_nulls_last()], "curve_order", "position")
    n_all = placed.count()  # one number
    out = placed.withColumn("number", F.expr(f"cast((position * {shards}) div {max(n_all, 1)} as int)"))
    begin = F.expr(f"(cast(number as bigint) * {n_all} + {shards - 1}) div {shards}")
    return out.select("row.*", F.struct(
        F.col("size"), F.col("crc").alias("text_crc32"), F.col("curve"), F.col("number").alias("shard"),
        (F.col("position") - begin).alias("slot")).alias(name))
