"""Benchmark decontamination: a prefix-filtered containment join.

A window is ``window`` consecutive item words (a shorter item is one window).
A window lies in a document only if each of its words does, so joining its
rarest word is enough (containment 1 needs a prefix of one token).  Rarity is
the word's count over all documents; a window whose rarest word never occurs
is dropped at once.  Neighbouring windows of an item share their rarest word,
so the index holds one row for each such word position with the range of
windows it stands for.

1. count the items' words over all documents;
2. join the documents' words with the index words: (document, position) pairs;
3. join back to the texts, grouped by document, and compare the words of each
   proposed window exactly, bounded by the document's length.

Defined results: NULL text or text without words has no words and is never
contaminated; items without words have no windows; equal item ids count once;
NULL ids are matched as a value of their own; rows with equal document ids are
judged on their own text; empty tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import Scratch, fresh, lower_ascii

WINDOW = 13
SHARE = 20  # contaminated if hits are at least one word in SHARE
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def alnum_words(text: Column) -> Column:
    """Runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII; NULL has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATOR), lambda w: w != "")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return (
        benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item_id"),
                         alnum_words(F.col(f"`{text_col}`")).alias("item_words"))
        .filter(F.size("item_words") > 0).distinct()
        .withColumn("item", F.xxhash64(F.coalesce("item_id", F.lit("")), F.concat_ws(" ", "item_words")))
    )


def _index(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(token, item, at, low, high): windows low..high of the item have their rarest word at ``at``."""
    tokens = items.select("item", F.posexplode("item_words").alias("at", "token")) \
        .join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    ranked = tokens.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "n", "token"))).alias("t"))
    starts = ranked.withColumn("low", F.explode(F.sequence(
        F.lit(0), F.greatest(F.size("t") - window, F.lit(0)))))
    rarest = F.array_min(F.transform(F.slice("t", F.col("low") + 1, window),
                                     lambda x: F.struct(x.n.alias("n"), x["at"].alias("at"), x.token.alias("token"))))
    return starts.select("item", "low", rarest.alias("r")).filter("r.n > 0") \
        .groupBy(F.col("r.token").alias("token"), "item", F.col("r.at").alias("at")) \
        .agg(F.min("low").alias("low"), F.max("low").alias("high"))


def find_hits(scratch: Scratch, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
              share: int = SHARE) -> DataFrame:
    """``docs`` with the struct ``hits`` (or a free name): n_words, n_hit, item_ids, contaminated."""
    name = fresh(docs.columns, "hits")
    items = scratch.table(_items(benchmark, item_col, item_text_col), "items")
    # written tables: their known sizes let Spark choose between broadcast and shuffle
    vocabulary = scratch.table(items.select(F.explode("item_words").alias("token")).distinct(), "vocabulary")
    text = F.col(f"`{text_col}`")
    counts = docs.select(F.explode(alnum_words(text)).alias("token")) \
        .join(vocabulary, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.table(counts, "counts")
    index = scratch.table(_index(items, counts, window), "index")
    prefixes = scratch.table(index.select("token").distinct(), "prefixes")

    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(alnum_words(text)).alias("pos", "token")) \
        .join(prefixes, "token", "left_semi").distinct()
    proposed = found.join(index, "token").join(items, "item") \
        .groupBy(F.col("id").alias("found_id")).agg(F.collect_list(
            F.struct("pos", "at", "low", "high", "item_id", "item_words")).alias("proposed"))
    proposed = scratch.publish(proposed.withColumn("has_proposed", F.lit(True)), "proposed")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    joined = rows.join(proposed, F.col("id").eqNullSafe(F.col("found_id")), "left") \
        .withColumn("words", alnum_words(F.col("text")))

    def confirmed(c: Column) -> Column:
        length = F.least(F.lit(window), F.size(c["item_words"]))
        first = c["pos"] - c["at"]
        fits = F.filter(F.sequence(c["low"], c["high"]), lambda s: (first + s >= 0) & (
            first + s + length <= F.size("words")) & (
            F.when(first + s >= 0, F.slice("words", F.greatest(first + s, F.lit(0)) + 1, length))
            == F.slice(c["item_words"], s + 1, length)))
        return F.transform(fits, lambda s: F.struct(
            (first + s).alias("start"), (first + s + length - 1).alias("stop"), c["item_id"].alias("item_id")))

    hits = F.flatten(F.transform("proposed", confirmed))
    judged = joined.select("row", F.size("words").cast("bigint").alias("n_words"),
                           F.when(F.col("has_proposed"), hits).alias("hit"))
    n_hit = F.coalesce(F.size(F.array_distinct(F.flatten(F.transform(
        "hit", lambda h: F.sequence(h["start"], h["stop"]))))), F.lit(0)).cast("bigint")
    found_items = F.coalesce(F.array_sort(F.array_distinct(F.transform(
        "hit", lambda h: F.coalesce(h["item_id"], F.lit(""))))), F.array().cast("array<string>"))
    out = judged.select("row", "n_words", F.when(F.col("hit").isNull(), F.lit(0)).otherwise(n_hit)
                        .cast("bigint").alias("n_hit"), found_items.alias("item_ids"))
    verdict = F.struct(
        "n_words", "n_hit", "item_ids",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))
    # one row out for each row in; a filter on the verdict then stays above it, instead of judging every row again
    return out.select("row.*", F.explode(F.array(verdict)).alias(name))
