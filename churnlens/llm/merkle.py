"""Merkle manifest of a dataset: a tree for each run of rows, a tree over the runs, a proof for each row.

H is the lower-case hex SHA-256 of its inputs, concatenated.  A leaf is H of
the row's fields, each ``-`` if NULL, otherwise its UTF-8 byte count, a colon
and the value.  In a run (rows of equal ``run_col``) leaves ascend by id; while
several nodes remain, every two consecutive ones become their H (the last one
alone its own H).  What remains is the run's subroot; subroots in order of the
run's value (NULL first, bytewise) make the root in the same way.

Per level, lag and lead columns of a fixed offset (1, 2, 4, ... rows) are
masked by slot and run length: at the first row of an even node the lead is its
sibling, at the first row of an odd one the lag; the first rows of even nodes
hash the parents.  ``BAND`` levels are one chain of windows over aligned
chunks of 2**BAND slots, all with the same partitioning and order (one
shuffle), so a run of any length is spread over tasks.  The chunks' nodes are
the leaves of the next band: the rows shrink by 2**BAND from band to band.
A row's proof is its band's siblings followed by its chunk's proof.

Defined results: NULL ids come first; rows equal in run and id are ordered by
leaf (equal rows keep a leaf each); a NULL run is a run of its own; a lone leaf
is its subroot, a lone subroot the root; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.llm.common import Scratch, fresh, global_positions

BAND = 10
LEFT, RIGHT, ALONE = 0, 1, 2  # a step's side: the folded node is a left child, a right child, without sibling


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return digest(*[field(c) for c in fields])


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its proof steps lead to."""
    return F.aggregate(steps, start, lambda node, s: digest(
        F.when(s["side"] == RIGHT, s["sibling"]).otherwise(F.lit("")), node,
        F.when(s["side"] == LEFT, s["sibling"]).otherwise(F.lit(""))))


def siblings(steps: Column) -> Column:
    """The proof's sibling hashes, lowest level first."""
    return F.transform(F.filter(steps, lambda s: s["side"] != ALONE), lambda s: s["sibling"])


def _band(nodes: DataFrame) -> DataFrame:
    """``nodes`` (run, slot, n, node, ...) with ``steps`` of BAND levels and, at chunk starts, ``top``.

    ``n`` is the run's number of nodes, slots are gapless from 0.
    """
    out = nodes.withColumn("chunk", F.shiftright("slot", BAND)).withColumn("top", F.col("node"))
    order = Window.partitionBy("run", "chunk").orderBy("slot")
    down = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(BAND):
        step = 1 << level
        slot = F.shiftright("slot", level)
        first, odd = F.col("slot").bitwiseAND(step - 1) == 0, slot.bitwiseAND(1) == 1
        growing = F.col("n") > step  # more than one node is left at this level
        sibling = F.when(odd, F.lag("top", step).over(order)) \
            .when(F.col("slot") + step < F.col("n"), F.lead("top", step).over(order)).otherwise(F.lit(""))
        out = out.withColumn("sibling", F.when(first, sibling))
        # every row below a node holds the sibling of its first row
        out = out.withColumn(f"sibling_{level}", F.last("sibling", ignorenulls=True).over(down))
        out = out.withColumn("top", F.when(first & ~odd, F.when(growing, digest(F.col("top"), F.col("sibling")))
                                           .otherwise(F.col("top"))))
    steps = []
    for level in range(BAND):
        sibling = F.col(f"sibling_{level}")
        side = F.when(sibling == "", ALONE).when(F.shiftright("slot", level).bitwiseAND(1) == 1, RIGHT).otherwise(LEFT)
        steps.append(F.when(F.col("n") > (1 << level), F.struct(side.alias("side"), sibling.alias("sibling"))))
    return out.withColumn("steps", F.filter(F.array(*steps), lambda s: s.isNotNull())) \
        .drop("chunk", "sibling", *[f"sibling_{level}" for level in range(BAND)])


def _tree(scratch: Scratch, nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(``nodes`` with the steps to their run's last node, (run, node) of these last nodes)."""
    bands = [scratch.table(_band(nodes), f"{name}_0")]
    while True:
        tops = bands[-1].filter(F.col("slot").bitwiseAND((1 << BAND) - 1) == 0).select(
            "run", F.shiftright("slot", BAND).alias("slot"),
            F.shiftright(F.col("n") + ((1 << BAND) - 1), BAND).alias("n"), F.col("top").alias("node"))
        longest = tops.agg(F.max("n")).first()[0]  # one number
        if longest is None or longest <= 1:
            break
        bands.append(scratch.table(_band(tops), f"{name}_{len(bands)}"))
    above = None
    for band in reversed(bands):
        if above is not None:
            up = above.select(F.col("run").alias("up_run"), F.col("slot").alias("up_slot"), F.col("steps").alias("more"))
            band = band.join(up, (F.col("run") == F.col("up_run")) & (F.shiftright("slot", BAND) == F.col("up_slot"))) \
                .withColumn("steps", F.concat("steps", "more")).drop("up_run", "up_slot", "more")
        above = band
    return above.drop("top", "node"), tops.select("run", "node")


def manifest(scratch: Scratch, docs: DataFrame, fields: list[str], id_col: str = "doc_id", run_col: str = "lang",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``carry`` (all of ``docs`` by default) and a struct ``merkle`` (or a free name).

    The struct holds leaf, slot, subroot, root and steps: (side, sibling) from
    the leaf up to the root, where side tells whether the sibling is to the
    right (0), to the left (1) or absent (2).
    """
    carry = {c: F.col(f"`{c}`") for c in docs.columns} if carry is None else carry
    name = fresh(list(carry), "merkle")
    rows = docs.select(F.struct(*[c.alias(k) for k, c in carry.items()]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                       F.col(f"`{run_col}`").alias("value"), leaf([F.col(f"`{c}`") for c in fields]).alias("node"))
    # written before the range sort, which reads its input twice
    rows = scratch.table(rows, "leaves")
    placed = global_positions(
        scratch, rows, [F.col("value").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("node")], "order", "place")
    runs = placed.groupBy("value").agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("n"))
    runs = global_positions(scratch, scratch.table(runs, "runs"), [F.col("begin")], "run_order", "run")
    runs = scratch.table(runs.withColumnRenamed("value", "run_value"), "numbered_runs")
    nodes = placed.join(runs, F.col("value").eqNullSafe(F.col("run_value"))) \
        .select("row", "run", (F.col("place") - F.col("begin")).alias("slot"), "n", "node", F.col("node").alias("leaf"))
    leaves, subroots = _tree(scratch, nodes, "tree")
    n_runs = runs.count()  # one number
    subroots = scratch.table(subroots, "subroots")
    upper = subroots.select(F.lit(0).cast("bigint").alias("run"), F.col("run").alias("slot"),
                            F.lit(n_runs).cast("bigint").alias("n"), "node", F.col("node").alias("subroot"))
    runs_up, root = _tree(scratch, upper, "roots")
    top = runs_up.join(root.select(F.col("run").alias("root_run"), F.col("node").alias("root")),
                       F.col("run") == F.col("root_run"))
    top = scratch.table(top.select(F.col("slot").alias("of_run"), "subroot", "root", F.col("steps").alias("more")), "top")
    out = leaves.join(top, F.col("run") == F.col("of_run")).select("row.*", F.struct(
        "leaf", "slot", "subroot", "root", F.concat("steps", "more").alias("steps")).alias(name))
    return scratch.publish(out, "manifest")
