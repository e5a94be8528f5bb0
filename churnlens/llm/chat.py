"""Chat formatting from event logs.

A conversation is a log of events, applied in order of ``seq``:

* ``delta``       appends ``text`` to the message's draft, starting it if needed;
* ``edit``        replaces the message's text by ``text``;
* ``regenerate``  discards the message's text; later deltas write it anew;
* ``drop``        removes the message.

``fold_events`` folds a log into final messages: the last reset (edit,
regenerate or drop) of a message is found by an aggregate, the deltas after it
are joined in order.  The unit of work is the message, not the conversation.
``render`` then writes each conversation as one string with the character
spans that carry loss (the assistant's texts); it streams the sorted messages,
holding one conversation's output at a time.

Template: ``<s>role``, a line end, the text, ``</s>`` for each turn.  Inside
roles and texts a backslash is doubled and each control string becomes a
backslash and its letter, so none can be read as a template mark and the
escaping is reversible.

Defined results: NULL text is empty, NULL role is the role ``""``; turns with
equal numbers are ordered by role and text, a NULL turn comes first; NULL
conversation ids are one conversation; an empty log gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
CONTROL = (BEGIN, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLES = ("assistant",)

_CODES = dict(zip(CONTROL, "abcdef")) | {"\\": "\\"}
_TEXTS = {code: text for text, code in _CODES.items()} | {"n": "\n"}
_ESCAPE = re.compile("|".join(map(re.escape, _CODES)))
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Text without any control string; ``unescape`` reverses it."""
    return _ESCAPE.sub(lambda m: "\\" + _CODES[m[0]], text)


def escape_role(role: str) -> str:
    """As ``escape``, on one line."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _TEXTS[m[1]], text)


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of a log.

    The log has conv_id, seq, turn, role, message (names the message within
    the conversation), kind and text; further columns are left out.  Events without a
    ``seq`` come first; of those with equal ``seq`` a delta does not outlast a reset; of equal resets the later
    one in (kind, text) counts, equal deltas are appended in order of their text.
    """
    key = ["conv_id", "turn", "role", "message"]
    events = events.select(*key, F.coalesce("seq", F.lit(-(1 << 63))).alias("seq"), "kind", "text")
    resets = events.filter(F.col("kind") != "delta").groupBy(*key).agg(F.max(F.struct("seq", "kind", "text")).alias("reset"))
    resets = resets.select(*[F.col(k).alias(f"reset_{k}") for k in key], "reset")
    same = [F.col(k).eqNullSafe(F.col(f"reset_{k}")) for k in key]
    after = events.join(resets, same[0] & same[1] & same[2] & same[3], "left") \
        .withColumn("counts", (F.col("kind") == "delta") & (F.col("reset").isNull() | (F.col("seq") > F.col("reset.seq"))))
    folded = after.groupBy(*key).agg(
        F.first("reset", ignorenulls=True).alias("reset"),
        F.sort_array(F.collect_list(F.when(F.col("counts"), F.struct(
            "seq", F.coalesce("text", F.lit("")).alias("text"))))).alias("deltas"))
    base = F.when(F.col("reset.kind") == "edit", F.coalesce("reset.text", F.lit(""))).otherwise("")
    gone = (F.col("reset.kind") == "drop") & (F.size("deltas") == 0)
    return folded.filter(~F.coalesce(gone, F.lit(False))) \
        .select("conv_id", "turn", "role", F.concat(base, F.array_join("deltas.text", "")).alias("text"))


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted messages to conversations; a conversation may span batches."""
    fields = [pa.field("conv_id", pa.int64()), pa.field("formatted", pa.string()),
              pa.field("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
    current, out, spans, length = object(), [], [], 0

    def done(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], [f.name for f in fields])

    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if conv != current:
                if out:
                    rows.append((current, "".join(out), spans))
                current, out, spans, length = conv, [], [], 0
            head, body = f"{BEGIN}{escape_role(role or '')}\n", escape(text or "")
            if role in LOSS_ROLES:
                spans.append({"start": length + len(head), "stop": length + len(head) + len(body)})
            out += (head, body, END)
            length += len(head) + len(body) + len(END)
        yield done(rows)
    if out:
        yield done([(current, "".join(out), spans)])


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row a conversation; ``loss`` lists [start, stop) character spans."""
    return messages.select("conv_id", "turn", "role", "text") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text") \
        .mapInArrow(_render, "conv_id long, formatted string, loss array<struct<start:long,stop:long>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part[len(BEGIN):].partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def loss_text(formatted: str, loss: list) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[s["start"]: s["stop"]]) for s in loss)
