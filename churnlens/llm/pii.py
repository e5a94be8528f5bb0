"""Personal data found by boosted trees over candidate spans.

1. Base spans: four patterns (email, ip, card, phone) with their checks; they
   are always kept.
2. Generators of high recall propose overlapping candidate spans for a kind:
   anything like an address with ``@`` or ``at``/``dot``, runs of digits with
   separators, plain digit runs, dotted quads.
3. Gradient-boosted trees score each candidate from its format (digits,
   groups, separators, checksum, parts) and its context (characters around it,
   cue words before it).  Right are rewritten base spans in their own context
   (``@`` and ``.`` as at/dot, no ``+``, no country code, digits regrouped, two
   cards run together); wrong are the pieces proposed around those, addresses whose
   only sign is the word "at" (prose: "look at example.com"), and
   candidates that meet no base span and fail the checks of their kind.
   Candidates that pass them in a form that rewriting gives (phones: one of the
   rewritten shapes, or after a cue word) are neither.  The trees are fitted on
   at most ``SAMPLE_DOCS`` documents (chosen by a hash of the id) and
   ``ROWS_PER_DOC`` times as many candidates, and turned into
   one SQL expression, so scoring the corpus is a narrow pass without Python.
4. Thresholds are calibrated for each kind on the right and wrong rows of all
   documents, by one aggregate over kind and rounded score: the lowest score
   from which at least ``PRECISION`` of them are right.  Kinds without such a
   score, or a corpus without both labels, select nothing.

Base spans and described candidates are written once, with the carried columns;
the fit, the calibration and the result read them there.

A selected candidate is added unless it overlaps a base span or a selected one
of higher score.  Positions are code points, end exclusive.

Defined results: NULL or empty text has no spans; repeated rows are judged
alike; NULL ids take part in the sample; an empty table gives no rows and no
model.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import Scratch, fresh

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 4000
PRECISION = 0.95
TREES, TREE_DEPTH = 12, 3
CONTEXT = 16
SNIPPET = 40  # characters kept on each side of a rewritten span
ROWS_PER_DOC = 10

# base patterns; possessive groups and the look-behind only keep long runs linear
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # fewer digits are no card
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# generators: (kinds proposed, pattern)
_GENERATORS = (
    (("email",), r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[(\[]at[)\]] ?|@| at )"
                 r"[A-Za-z0-9-]++(?:(?: ?[(\[]dot[)\]] ?|\.| dot )[A-Za-z0-9-]++)++"),
    (("phone", "card"), r"\+?[0-9](?:[ ().-]{0,2}[0-9]){6,}+"),
    (("phone", "card"), r"(?<![0-9])[0-9]{7,}+"),
    (("phone",), r"\([0-9]{1,4}\)(?:[ ().-]{0,2}[0-9]){6,}+"),
    (("ip",), r"(?<![0-9.])[0-9]{1,3}(?:(?:\.| ?[(\[](?:dot|\.)[)\]] ?| dot )[0-9]{1,3}){3}(?![0-9])"),
)
_CUES = r"(?i)(?:mail|phone|call|tel|fax|card|visa|ip|host|address|contact)[^\w]*$"


def _spans(text: Column, pattern: str) -> Column:
    """array of (start, stop, match): the pieces between matches give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda m, p: F.struct(
        m.alias("m"), F.char_length(p).cast("bigint").alias("gap"), F.char_length(m).cast("bigint").alias("n")))
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint,match:string>>)")
    return F.aggregate(
        pairs, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("stop"),
                x["m"].alias("match")))).alias("out")),
        lambda acc: acc["out"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + _luhn_digit(digits, i))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _luhn_digit(digits: Column, i: Column) -> Column:
    d = F.coalesce(F.substring(digits, F.length(digits) - i + 1, F.lit(1)).try_cast("int"), F.lit(0))
    doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.when(i % 2 == 0, doubled).otherwise(d)


def _small_parts(s: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))
    return F.forall(F.split(s, r"\."), small)


def _valid(kind: str, s: Column) -> Column:
    digits = _digits(s)
    n = F.length(digits)
    if kind == "ip":
        return _small_parts(s)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _written_address(s: Column) -> Column:
    """An address by more than the word "at": ``@``, a bracketed at, or a dot in words; its last part is letters."""
    return s.rlike(r"@|[(\[]at[)\]]| dot |[(\[]dot[)\]]") & _plain(s).rlike(r"\.[A-Za-z]{2,}$")


def _base_of(text: Column, k: int, pattern: str) -> Column:
    spans = F.filter(_spans(text, pattern), lambda s: _valid(KINDS[k], s["match"]))
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(k).alias("kind"), s["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    """array of (start, kind, stop): the base spans, by start, then kind (an index into KINDS)."""
    marks = {"email": text.contains("@"), "phone": text.contains("+")}
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,stop:bigint>>)")
    found = [F.when(marks.get(KINDS[k], text.rlike("[0-9]")), _base_of(text, k, pattern)).otherwise(none)
             for k, pattern in enumerate((_EMAIL, _IP, _CARD, _PHONE))]
    return F.array_sort(F.concat(*found))


def _proposed(text: Column, spans: Column, kind: str) -> Column:
    least = 7 if kind in ("phone", "card") else 0
    enough = F.filter(spans, lambda s: F.length(_digits(s["match"])) >= least)
    return F.transform(enough, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["stop"].alias("stop"),
        s["match"].alias("match"),
        F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)).cast("int") + 1,
                    F.least(s["start"], F.lit(CONTEXT)).cast("int")).alias("before"),
        F.substring(text, s["stop"].cast("int") + 1, F.lit(CONTEXT)).alias("after")))


def candidate_spans(text: Column) -> Column:
    """array of (start, kind, stop, match, before, after) from all generators."""
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,stop:bigint,match:string,"
                  "before:string,after:string>>)")
    found = []
    for kinds, pattern in _GENERATORS:
        guard = text.rlike(r"@|[(\[]at[)\]]| at [A-Za-z0-9-]++(?: ?[(\[]dot| dot |\.)") if kinds == ("email",) else text.rlike("[0-9]")
        spans = _spans(text, pattern)
        found += [F.when(guard, _proposed(text, spans, kind)).otherwise(none) for kind in kinds]
    return F.array_distinct(F.concat(*found))


def _plain(s: Column) -> Column:
    """at/dot and bracketed dots written as ``@`` and ``.``."""
    return F.regexp_replace(F.regexp_replace(s, r" ?[(\[]at[)\]] ?| at ", "@"), r" ?[(\[](?:dot|\.)[)\]] ?| dot ", ".")


def features(c: Column) -> list[tuple[str, Column]]:
    """Format and context features of a candidate (a struct column)."""
    s, digits = c["match"], _digits(c["match"])
    plain = _plain(s)
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    number = lambda col: col.cast("double")
    groups = F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))
    longest = F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0))
    return [
        ("kind", number(c["kind"])),
        ("length", number(F.char_length(s))),
        ("n_digits", number(F.length(digits))),
        ("n_groups", number(F.size(groups))),
        ("longest_group", number(longest)),
        ("n_dots", number(F.length(plain) - F.length(F.replace(plain, F.lit("."), F.lit(""))))),
        ("n_letters", number(F.length(F.regexp_replace(s, "[^A-Za-z]", "")))),
        ("has_at", flag(s.contains("@"))),
        ("in_words", flag(s.rlike(r"[(\[]at[)\]]| dot |[(\[](?:dot|\.)[)\]]"))),
        ("has_paren", flag(s.contains("("))),
        ("has_plus", flag(s.startswith("+"))),
        ("luhn", flag(luhn(digits))),
        ("small_parts", flag(_small_parts(F.regexp_replace(plain, "[^0-9.]", "")))),
        ("last_part", number(F.length(F.substring_index(plain, ".", -1)))),
        ("cue", flag(c["before"].rlike(_CUES))),
        ("joined_before", flag(c["before"].rlike(r"[\w.@]$"))),
        ("joined_after", flag(c["after"].rlike(r"^\w"))),
        ("digits_around", number(F.length(_digits(F.concat(c["before"], c["after"]))))),
    ]


# ---- model ---------------------------------------------------------------

def _described(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """The carried columns (as c0, c1, ...), a hash of the id, the base spans and the described candidates."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
                       F.xxhash64(F.lit("pii"), F.col(f"`{id_col}`")).alias("draw"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("found", candidate_spans(F.col("text")))


    def passes(c: Column) -> Column:
        checks = [_written_address(c["match"]) if k == "email" else _valid(k, _plain(c["match"])) for k in KINDS]
        return F.element_at(F.array(*checks), c["kind"] + 1)

    free = F.filter("found", lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    described = F.transform(free, lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"), passes(c).alias("passes"),
        F.regexp_replace(c["match"], "[0-9]", "9").alias("shape"),
        F.struct(*[f.alias(n) for n, f in features(c)]).alias("f")))
    marks = F.transform("base", lambda b: F.struct(
        b["kind"].alias("kind"),
        F.substring("text", F.greatest(b["start"] - SNIPPET, F.lit(0)).cast("int") + 1,
                    F.least(b["start"], F.lit(SNIPPET)).cast("int")).alias("before"),
        F.substring("text", b["start"].cast("int") + 1, (b["stop"] - b["start"]).cast("int")).alias("match"),
        F.substring("text", b["stop"].cast("int") + 1, F.lit(SNIPPET)).alias("after")))
    return scratch.publish(rows.withColumn("described", described).withColumn("marks", marks).drop("text", "found"),
                           "described")


def _forms(kind: Column, s: Column) -> Column:
    """array of (prefix, body, suffix, right): a base span of ``kind`` rewritten; ``body`` is to be found, or not if wrong."""
    def form(body: Column, prefix: Column | None = None, suffix: Column | None = None, right: bool = True) -> Column:
        return F.struct((F.lit("") if prefix is None else prefix).alias("prefix"), body.alias("body"),
                        (F.lit("") if suffix is None else suffix).alias("suffix"), F.lit(right).alias("right"))

    name, host, digits = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1), _digits(s)
    swap = lambda text, dot: F.replace(text, F.lit("."), F.lit(dot))
    emails = [form(F.concat(name, F.lit(at), swap(host, dot))) for at, dot in (
        (" at ", " dot "), ("(at)", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "))]
    # the word "at" alone is prose, with a host or with a sentence that goes on without a space
    emails += [form(F.concat(name, F.lit(" at "), host), right=False),
               form(F.concat(name, F.lit(" at "), F.substring_index(host, ".", 1), F.lit("."), F.initcap(name)), right=False)]
    ips = [form(swap(s, dot)) for dot in ("[.]", "(dot)", " dot ")]
    spaced = lambda text, by: F.regexp_replace(text, r"([0-9]{4})(?=[0-9])", f"$1{by}")
    cards = [form(spaced(digits, ".")), form(spaced(digits, "  ")), form(s, suffix=F.concat(F.lit(" "), s)),
             form(s, prefix=F.concat(s, F.lit(" ")))]
    bare, local = F.expr("substring(m.match, 2)"), F.right(digits, F.lit(10))
    grouped = lambda by: F.regexp_replace(local, "^([0-9]{3})([0-9]{3})", f"$1{by}$2{by}")
    phones = [form(x) for x in (bare, F.regexp_replace(s, r"^\+[0-9]{1,3}[ .-]*(?=[(0-9])", ""), digits, local,
                                grouped("-"), grouped("."), grouped(" "))]
    by_kind = [emails, ips, cards, phones]
    return F.element_at(F.array(*[F.array(*forms) for forms in by_kind]), kind + 1)


def _rewritten(scratch: Scratch, described: DataFrame) -> DataFrame:
    """Candidates around the rewritten base spans of all documents; right (label 1) are those that equal the span."""
    forms = described.select("draw", F.explode("marks").alias("m")) \
        .select("draw", "m", F.explode(_forms(F.col("m.kind"), F.col("m.match"))).alias("w"))
    written = forms.select(
        "draw", "m.kind", F.concat("m.before", "w.prefix", "w.body", "w.suffix", "m.after").alias("text"),
        (F.char_length("m.before") + F.char_length("w.prefix")).alias("start"), F.char_length("w.body").alias("n"), "w.right")
    near = written.select("draw", F.col("kind").alias("own"), "right", "start", (F.col("start") + F.col("n")).alias("stop"),
                          F.explode(candidate_spans(F.col("text"))).alias("c")) \
        .filter("c.kind = own AND c.start < stop AND start < c.stop")
    equal = F.col("right") & (F.col("c.start") == F.col("start")) & (F.col("c.stop") == F.col("stop"))
    return scratch.table(near.select(
        "draw", F.col("own").alias("kind"), equal.cast("double").alias("label"),
        F.regexp_replace("c.match", "[0-9]", "9").alias("shape"),
        F.struct(*[f.alias(n) for n, f in features(F.col("c"))]).alias("f")), "rewritten")


def _labelled(scratch: Scratch, described: DataFrame) -> DataFrame:
    """(draw, kind, label, f) of all documents: right and wrong rows."""
    rewritten = _rewritten(scratch, described)
    phone = KINDS.index("phone")
    shapes = rewritten.filter((F.col("kind") == phone) & (F.col("label") == 1) & F.col("shape").rlike("[^0-9]")) \
        .select(F.col("shape").alias("known_shape")).distinct()
    shapes = scratch.table(shapes, "shapes")
    rows = described.select("draw", F.explode("described").alias("c")) \
        .join(shapes, F.col("c.shape") == F.col("known_shape"), "left")
    known = F.col("c.passes") & ((F.col("c.kind") != phone) | (F.col("c.f.cue") == 1) | F.col("known_shape").isNotNull())
    wrong = rows.filter(~known).select("draw", "c.kind", F.lit(0.0).alias("label"), "c.f")
    return rewritten.select("draw", "kind", "label", "f").union(wrong)


def _sample(scratch: Scratch, labelled: DataFrame, sample_docs: int) -> DataFrame:
    """Rows of at most ``sample_docs`` documents, half of them with right and half with wrong rows, by a hash of the id."""
    right, wrong = (labelled.filter(F.col("label") == k).select("draw").distinct().orderBy("draw")
                    .limit(max(1, sample_docs // 2)) for k in (1, 0))
    drawn = scratch.table(right.union(wrong).distinct(), "drawn")
    rows = labelled.join(drawn, "draw", "left_semi").select(
        F.xxhash64("draw", "label", "f").alias("draw"), "label", "f.*")
    # as many candidates as fit the bound, in a fixed order
    return scratch.table(rows.dropDuplicates(["draw"]).orderBy("draw").limit(ROWS_PER_DOC * sample_docs), "sample")


def _tree_sql(text: str, names: list[str]) -> str:
    """A fitted tree's description as nested CASE expressions."""
    lines = [line.strip() for line in text.splitlines() if re.match(r"\s*(If|Else|Predict)", line)]

    def node(at: int) -> tuple[str, int]:
        if lines[at].startswith("Predict"):
            return f"{float(lines[at].split(':')[1])!r}D", at + 1
        feature, value = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
        left, at = node(at + 1)
        right, at = node(at + 1)
        return f"CASE WHEN f.{names[int(feature)]} <= {float(value)!r}D THEN {left} ELSE {right} END", at
    return node(0)[0]


def fit(scratch: Scratch, described: DataFrame, sample_docs: int = SAMPLE_DOCS,
        precision: float = PRECISION) -> tuple[str, dict[int, float]] | None:
    """(score as SQL over a feature struct ``f``, threshold of each kind), or None without both labels."""
    labelled = _labelled(scratch, described)
    sample = _sample(scratch, labelled, sample_docs)
    names = [c for c in sample.columns if c not in ("draw", "label")]
    train = VectorAssembler(inputCols=names, outputCol="features").transform(sample)
    if len(train.select("label").distinct().collect()) < 2:
        return None
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=TREE_DEPTH,
                          stepSize=0.3, seed=7).fit(train.coalesce(2))
    score = " + ".join(f"{w!r}D * ({_tree_sql(t.toDebugString, names)})" for t, w in zip(model.trees, model.treeWeights))
    scored = labelled.select("kind", "label", F.round(F.expr(score), 2).alias("score"))
    # one row for each kind and score in steps of 0.01
    bins = scored.groupBy("kind", "score").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("n")) \
        .orderBy("kind", F.col("score").desc()).collect()
    thresholds: dict[int, float] = {}
    right = seen = 0.0
    kind = None
    for r in bins:
        if r["kind"] != kind:
            kind, right, seen = r["kind"], 0.0, 0
        right, seen = right + r["right"], seen + r["n"]
        if right >= precision * seen and r["score"] > 0:
            thresholds[int(kind)] = r["score"]
    return score, thresholds


def find_spans(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               carry: list[str] | None = None, sample_docs: int = SAMPLE_DOCS,
               precision: float = PRECISION) -> DataFrame:
    """Rows of ``docs`` with the struct ``pii`` (or a free name): base and spans, arrays of (start, kind, stop)."""
    carry = list(docs.columns) if carry is None else carry
    name = fresh(docs.columns, "pii")
    described = _described(scratch, docs, id_col, text_col, carry)
    carried = [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    model = fit(scratch, described, sample_docs, precision)
    if model is None or not model[1]:
        return described.select(*carried, F.struct("base", F.col("base").alias("spans")).alias(name))
    score, thresholds = model
    chosen = described.withColumn("scored", F.expr(
        "transform(described, x -> struct(x.start AS start, x.kind AS kind, x.stop AS stop, "
        f"transform(array(x.f), f -> {score})[0] AS score))"))
    limits = " ".join(f"WHEN {k} THEN {v!r}D" for k, v in sorted(thresholds.items()))
    chosen = chosen.withColumn("selected", F.expr(
        f"filter(scored, x -> round(x.score, 2) >= (CASE x.kind {limits} END))"))
    chosen = chosen.withColumn("added", F.expr(
        "transform(filter(selected, x -> NOT exists(selected, y -> y.start < x.stop AND x.start < y.stop AND "
        "struct(y.score, -y.start, -y.kind, y.stop) > struct(x.score, -x.start, -x.kind, x.stop))), "
        "x -> struct(x.start AS start, x.kind AS kind, x.stop AS stop))"))
    spans = F.array_sort(F.concat("base", "added"))
    return chosen.select(*carried, F.struct("base", spans.alias("spans")).alias(name))


def label_spans(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(
        F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")
