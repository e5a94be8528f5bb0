"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (NULL last) weigh 5, 2, 1, 5, 2, 1, ...
and share the corpus' words by weight; a target stops at ``cap`` times its
source's size and the excess is shared again by weight among the rest.  The
fixed point has a closed form: order the sources by size / weight, cap a
prefix of them, share what is left.

Sampling: within a source each document is expected ``target / size of the
source`` times.  Documents lie in order of size (an implicit stratification:
the taken words stay within about one document of the target), the expected
copies are prefix-summed, one random offset a source is added, and a document
is emitted once for each integer boundary that its step crosses.  The offset
is drawn as the best of a grid: ``OFFSETS`` offsets evenly apart from a random
first one, of which that with the taken words nearest the target is used.

Prefix sums are exact integers in units of 1e-9 copies; all documents of a
source expect the same number, so the sum is the document's position times
that number.  The position is global (range shuffle of slim rows), so a hot
source is spread over all tasks.

Defined results: NULL or empty text has size 0 and is taken 0 words (it may
still be emitted); repeated rows are separate documents; NULL source is a
source of its own, last; an empty table gives an empty mix; NULL ids sort
last.  Equal seeds and rows give equal mixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.llm.common import Scratch, count_words, fresh, global_positions

UNIT = 1_000_000_000
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
OFFSETS = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_docs) -> the same with weight and target.

    One row a source: the windows run over the list of sources only.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.select("*", place.alias("place"), pick.cast("bigint").alias("weight"))
    by_ratio = [F.col("source_size") / F.col("weight"), F.col("place")]
    before = Window.orderBy(*by_ratio).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*by_ratio).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    big = "decimal(38,0)"
    steps = weighed.select(
        "*",
        (F.col("source_size") * cap).alias("most"),
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("source_size").over(before) * cap, F.lit(0)).alias("capped_before"),
        F.sum("weight").over(rest).alias("weight_left"),
    )
    is_capped = ((F.col("total") - F.col("capped_before")).cast("decimal(28,0)") * F.col("weight").cast("decimal(9,0)")
                 > F.col("most").cast("decimal(28,0)") * F.col("weight_left").cast("decimal(9,0)"))
    flagged = steps.withColumn("is_capped", is_capped)
    left = (F.col("total") - F.sum(F.when(F.col("is_capped"), F.col("most")).otherwise(0)).over(every))
    open_weight = F.sum(F.when(F.col("is_capped"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("is_capped"), F.col("most").cast("double")).otherwise(
        left.cast("double") * F.col("weight") / open_weight)
    return flagged.withColumn("target", target).select("source", "source_size", "n_docs", "place", "weight", "target")


def _offset(seed: str):
    """One offset a source in [0, UNIT), from the seed and the source's name."""
    label = F.when(F.col("source").isNull(), F.lit(f"{seed}:")).otherwise(F.concat(F.lit(f"{seed}=") , F.col("source")))
    return F.conv(F.substring(F.md5(label), 1, 12), 16, 10).cast("bigint") % UNIT


def mix(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED,
        carry: list[str] | None = None) -> DataFrame:
    """Each document with its size, its source's size and target, and its ``copies`` in the mix.

    ``carry`` lists the columns of ``docs`` kept (all by default; drop the
    text where it is not needed).  The five added columns are in the struct
    ``mix`` (another free name if the frame has such a column).
    """
    carry = list(docs.columns) if carry is None else carry
    name = fresh(docs.columns, "mix")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("source"),
        count_words(F.col(f"`{text_col}`")).alias("size"),
    )
    placed = global_positions(
        scratch, keyed,
        [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("id").asc_nulls_last()], "mix_order", "position")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(sizes, weights, cap)
    begin = F.coalesce(F.sum("n_docs").over(
        Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0)
    plan = targets.select("source", "source_size", "target", begin.alias("begin"), step.cast("bigint").alias("step"),
                          _offset(seed).alias("offset"))
    plan = scratch.publish(plan.withColumnRenamed("source", "plan_source"), "mix_plan")
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    passed = (((F.col("position") - F.col("begin")) % UNIT) * (F.col("step") % UNIT) + F.col("offset")) % UNIT
    stepped = joined.withColumn("passed", passed)

    def copies(k: Column) -> Column:
        start = (F.col("passed") + k * (UNIT // OFFSETS)) % UNIT + F.col("step")
        return ((start - start % UNIT) / UNIT).cast("bigint")

    taken = stepped.groupBy("plan_source").agg(
        F.first("target").alias("goal"),
        *[F.sum(copies(F.lit(k)) * F.col("size")).alias(f"taken_{k}") for k in range(OFFSETS)])
    best = F.array_min(F.array(*[F.struct(
        F.abs(F.col(f"taken_{k}") - F.col("goal")).alias("miss"), F.lit(k).cast("bigint").alias("k"))
        for k in range(OFFSETS)]))["k"]
    chosen = scratch.publish(taken.select(F.col("plan_source").alias("best_source"), best.alias("best")), "mix_offsets")
    out = stepped.join(chosen, F.col("source").eqNullSafe(F.col("best_source"))).withColumn("copies", copies(F.col("best")))
    return out.select("row.*", F.struct(
        F.col("size"), F.col("source_size"), F.col("target"), F.col("copies"),
        (F.col("copies") * F.col("size")).alias("taken")).alias(name))
