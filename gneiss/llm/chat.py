"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; neighbours of one role share a block:

    <|im_start|>role\\n text <|im_sep|> text <|im_end|>\\n

Texts keep every character: a "<", any backslashes and a "|" get one more backslash, so "<|" occurs in
control strings alone and a reader can undo it. Roles write "%", line feed and "<" as %25, %0A and %3C.
The loss mask is kept as segments: the output is their concatenation, and the assistant's texts are true.

Defined results: null text or role is empty; turns that tie are ordered by role, then text; repeated
rows are turns of their own; a null conv_id is a conversation; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    for raw, coded in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(raw), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for raw, coded in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(raw))
    return role


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, segments array<struct<text, loss>>, formatted.

    ``formatted`` is the segments' text in one string. One shuffle, by conversation. A conversation is
    one value of the result, so its rows have to meet; work on it is linear in its length.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = F.col("turns")

    def pieces(t: Column, i: Column) -> Column:
        same = F.coalesce(F.get(turns, i - 1)["role"] == t["role"], F.lit(False))
        ended = F.when(i > 0, F.lit(f"{END}\n")).otherwise(F.lit(""))
        head = F.when(same, F.lit(SEP)).otherwise(F.concat(ended, F.lit(START), escape_role(t["role"]), F.lit("\n")))
        return F.array(_piece(head, F.lit(False)), _piece(escape(t["text"]), t["role"] == loss_role))

    last = F.array(_piece(F.lit(f"{END}\n"), F.lit(False)))
    segments = chats.select("conv_id", F.concat(F.flatten(F.transform(turns, pieces)), last).alias("segments"))
    return segments.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_chats(formatted: Column) -> Column:
    """The turns in a formatted string: array<struct<role, text>>."""

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape_role(F.substring(head, F.lit(len(START) + 1), F.length(head)))
        body = F.substring(block, F.length(head) + 2, F.length(block))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    return F.flatten(F.transform(blocks, turns))


def digest_chats(chats: DataFrame) -> DataFrame:
    """What can be read back from ``format_chats``: turns, and the text under the loss mask."""
    back = chats.select(
        "conv_id",
        "formatted",
        read_chats(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"),
    )
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
