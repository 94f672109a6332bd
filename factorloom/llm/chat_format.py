"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply is trainable.
The examples of a conversation are prefixes of one stream, written a row per turn (``render``). ``expanded`` writes every
example out, context and reply as text with its loss mask, and ``digest`` reads those texts back; their space grows with the
square of a conversation's turns, as the method has it. ``examples`` only names prefixes and trainable spans by offsets
into the stream, for those who store the stream once.

A turn is written ``### role: text</turn>`` and a line end. Inside role and text a backslash stands before each
backslash and each control string, and before a colon in a role, so every string reads back as it was.

Turns are in order of turn, then role, then text (nulls first); repeated rows are turns of their own; null role or text
counts as empty; a null conv_id is a conversation like any other. A conversation without assistant turns has no example.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
TRAINABLE = "assistant"
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\###"))
    return F.replace(text, F.lit("</turn>"), F.lit("\\</turn>"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, position, piece, is_target, and its offsets (code points) in the conversation's stream:
    start, body_start, body_end, end."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    header = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(COLON))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    pieces = turns.select("conv_id", "turn", "role", "text", header.alias("header"), escape(F.col("text")).alias("body"))
    size = F.length("header") + F.length("body") + F.lit(len(CLOSE))
    return (pieces.withColumn("position", F.row_number().over(order))
            .withColumn("end", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .select("conv_id", F.col("position").cast("long").alias("position"),
                    F.concat("header", "body", F.lit(CLOSE)).alias("piece"), (F.col("role") == TRAINABLE).alias("is_target"),
                    (F.col("end") - size).alias("start"), (F.col("end") - size + F.length("header")).alias("body_start"),
                    (F.col("end") - len(CLOSE)).alias("body_end"), "end"))


def expanded(rendered: DataFrame) -> DataFrame:
    """The examples as text, a row per assistant turn: conv_id, target (its position), context (all turns before it as they
    were written), reply, and the loss mask [loss_start, loss_end) in context and reply together. A conversation that goes on
    after its last assistant turn, or has none, adds a row for its last turn, without a target or a mask."""
    order = Window.partitionBy("conv_id").orderBy("position")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    target = lambda c: F.when(F.col("is_target"), F.col(c))
    return (rendered.withColumn("context", F.array_join(F.collect_list("piece").over(before), ""))
            .withColumn("following", F.lead("position").over(order)).where("is_target OR following IS NULL")
            .select("conv_id", "position", target("position").alias("target"), "context", F.col("piece").alias("reply"),
                    target("body_start").alias("loss_start"), target("body_end").alias("loss_end")))


def examples(rendered: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, target, and its example as offsets into the stream: context_end, loss_start,
    loss_end, length."""
    return rendered.where("is_target").select("conv_id", F.col("position").alias("target"), F.col("start").alias("context_end"),
                                              F.col("body_start").alias("loss_start"), F.col("body_end").alias("loss_end"), F.col("end").alias("length"))


def flat_examples(rendered: DataFrame) -> DataFrame:
    """Examples as whole strings: conv_id, target, context, reply, and the mask's offsets inside context and reply."""
    return expanded(rendered).where("target IS NOT NULL").drop("position")


def read_piece(piece: str) -> tuple[str, int]:
    """The role of a written turn and where its body starts."""
    found = HEADER.match(piece)
    if not found or not piece.endswith(CLOSE):
        raise ValueError("not a turn of this template")
    return unescape(found[1]), found.end()


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "n_examples long")


def digest(rendered: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples as they were written out: the turns from their contexts and replies, the
    trainable text from under their masks, and their summed length. An example whose context does not begin with the whole
    example before it, whose reply is no assistant's, or whose mask is not the reply's text, is an error."""
    return read_back(expanded(rendered))


def read_back(written: DataFrame) -> DataFrame:
    """``digest`` of what ``expanded`` gives.

    A hash runs through its conversation in order, so a task streams over its conversations' examples and holds one example
    of one conversation.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = object()
        key, turns, loss, sums, held = none, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0], ""
        columns = ("key", "context", "reply", "target", "loss_start", "loss_end")

        def row():
            return (key, sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), sums[2], sums[3])

        for batch in batches:
            out = []
            for conv, context, reply, target, lo, hi in zip(*(batch[c] for c in columns)):
                if conv != key:
                    if key is not none:
                        out.append(row())
                    key, turns, loss, sums, held = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0], ""
                if not context.startswith(held):
                    raise ValueError("the context is not all turns before its reply")
                stream, at, last = context + reply, len(held), None
                while at < len(stream):
                    last = TURN.match(stream, at)
                    if not last:
                        raise ValueError("not a turn of this template")
                    turns.update(f"{unescape(last[1])}\n{unescape(last[2])}\n".encode())
                    sums[0] += 1
                    at = last.end()
                if last is None or last.start() != len(context):
                    raise ValueError("the reply is not the one turn after its context")
                if target >= 0:
                    if (target, unescape(last[1]), (lo, hi)) != (sums[0], TRAINABLE, last.span(2)):
                        raise ValueError("not the example of this turn")
                    masked = unescape(stream[int(lo):int(hi)])
                    loss.update(masked.encode())
                    sums[1] += len(masked)
                    sums[2] += len(stream)
                    sums[3] += 1
                held = stream
            yield to_frame(out)
        if key is not none:
            yield to_frame([row()])

    def to_frame(rows):
        names = [x.split()[0] for x in DIGEST.split(", ")]
        made = pd.DataFrame(rows, columns=names)
        made["conv_id"] = made["conv_id"].map(lambda k: int(k) if k else None).astype("Int64")
        return made

    # the window of ``expanded`` has dealt rows by conversation and put them in this order
    fields = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("target", "loss_start", "loss_end")]
    rows = written.select("conv_id", "position", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "context", "reply", *fields)
    return rows.sortWithinPartitions("conv_id", "position").mapInPandas(run, DIGEST)
