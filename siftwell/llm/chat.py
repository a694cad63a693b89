r"""Conversations as one text each, by Spark expressions alone.

The turns of a conversation are collected as structs and sorted by turn;
adjacent turns of one role are merged by an array aggregation, and the merged
turns are joined as

    <|role>text</turn>        one merged turn, then a line end
    <|role>text<+>text</turn> where two turns of a role were merged

Texts and roles are escaped so that no control string can come from them: a
backslash becomes ``\b`` and ``<`` becomes ``\l`` (in roles also ``>`` becomes
``\g``). After that each backslash begins an escape and each ``<`` a mark, so
a plain split and two replacements read everything back, turn borders included.

The loss mask lists the places of the assistant's texts in the result, one span
for each original turn, in code points and in bytes; marks are never under it.

Defined results: a null text or role is empty. Equal turn numbers are ordered
by role, then text, and null turns come first. Repeated rows are turns of their
own. Rows without a conversation id form one conversation. An empty table has
no conversations. Extra columns are not read.

A conversation becomes one row by definition, so it has to fit in a task; the
texts are collected as they are and escaped once sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

LOSS_ROLE = "assistant"
OPEN, CLOSE, PART, END = "<|", ">", "<+>", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\g"), F.lit(">")))


def _merged(turns: Column) -> Column:
    """Sorted turns with neighbours of one role put together: an array of (role, parts)."""
    kind = "array<struct<role:string,parts:array<string>>>"

    def add(done, turn):
        last = F.get(done, F.size(done) - 1)
        own = F.array(turn["text"])
        return F.when((F.size(done) > 0) & (last["role"] == turn["role"]), F.concat(
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(turn["role"].alias("role"), F.concat(last["parts"], own).alias("parts"))))).otherwise(
            F.concat(done, F.array(F.struct(turn["role"].alias("role"), own.alias("parts")))))

    return F.aggregate(turns, F.array().cast(kind), add)


def _starts(sizes: Column, gap: int) -> Column:
    """Where each of some strings begins if they are joined by ``gap`` characters."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(sizes, none, lambda a, n: F.concat(
        a, F.array(F.when(F.size(a) == 0, F.lit(0).cast("bigint")).otherwise(F.get(a, F.size(a) - 1)) + n + gap)))


def _spans(merged: Column, pieces: Column, length) -> Column:
    """(start, end) of every loss part, in the unit that ``length`` counts."""
    def inside(turn, base):
        head = base + len(OPEN) + length(turn["role"]) + len(CLOSE)
        return let(_starts(F.transform(turn["parts"], lambda p: length(p).cast("bigint")), len(PART)), lambda after: F.transform(
            turn["parts"], lambda p, j: F.struct(
                (head + F.get(after, j) - length(p) - len(PART)).alias("start"), (head + F.get(after, j) - len(PART)).alias("end"))))

    return let(_starts(F.transform(pieces, lambda p: length(p).cast("bigint")), 0), lambda after: F.flatten(F.transform(
        merged, lambda m, i: F.when(m["role"] == LOSS_ROLE, inside(m, F.get(after, i) - length(F.get(pieces, i))))
        .otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")))))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss, loss_bytes): the text, and the spans of the loss mask in code points and in bytes."""
    rows = turns.select(turns[f"`{conv_id}`"].alias("conv_id"), F.struct(
        turns[f"`{turn}`"].alias("turn"), F.coalesce(turns[f"`{role}`"], F.lit("")).alias("role"),
        F.coalesce(turns[f"`{text}`"], F.lit("")).alias("text")).alias("t"))
    # Sorted as they are: escapes do not keep the order of tied turns.
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.transform(
        "turns", lambda t: F.struct(_escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("text"))).alias("turns"))
    made = let(_merged(F.col("turns")), lambda merged: let(
        F.transform(merged, lambda m: F.concat(F.lit(OPEN), m["role"], F.lit(CLOSE), F.array_join(m["parts"], PART), F.lit(END))),
        lambda pieces: F.struct(F.array_join(pieces, "").alias("formatted"), _spans(merged, pieces, F.length).alias("loss"),
                                _spans(merged, pieces, F.octet_length).alias("loss_bytes"))))
    return gathered.select("conv_id", made.alias("made")).select("conv_id", "made.*")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")

    def turns_in(block):
        at = F.instr(block, CLOSE)
        role = _unescaped_role(F.substring(block, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        parts = F.split(F.substring(block, at + 1, F.length(block)), F.lit(r"<\+>"))
        return F.transform(parts, lambda p: F.struct(role.alias("role"), unescaped(p).alias("text")))

    return F.flatten(F.transform(blocks, turns_in))


def read_loss(formatted: Column, loss_bytes: Column) -> Column:
    """The text under the mask, unescaped: each span cut out of the bytes, nothing between."""
    return let(formatted.cast("binary"), lambda body: unescaped(F.array_join(F.transform(
        loss_bytes, lambda s: F.substring(body, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string")), "")))
