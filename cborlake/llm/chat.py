"""Chat formatting by event-sourced reconstruction.

A log holds events of a conversation in sequence: ``message`` opens a message with a first text, ``delta``
appends streamed text, ``edit`` replaces the whole text, ``regenerate`` throws the text away and starts anew,
``delete`` removes the message. Folding an event log gives final messages; rendering wraps each in control
strings and escapes control strings inside texts, so that the output can be read back without loss.
Built-in expressions only.

Defined results: null texts and roles are empty; events of equal sequence number are ordered by kind, then
role, then text; identical rows of a ``message`` log are messages of their own. A null conversation id is a
conversation of its own. Other columns of the log are not carried. An empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "<|im_start|>", "<|im_end|>"
#: Kinds of events that throw away what a message held before.
RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    """No output holds ``<|``; ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """As escape; line ends, which end a role, become ``\\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def fold(events: DataFrame) -> DataFrame:
    """events: conv_id, seq, message_id, copy (tells apart messages of one id), kind, role, text. Returns conv_id,
    message_id, copy, first_seq, role, text of the messages left. Work is dealt by conversation and message, so a
    long conversation is spread."""
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = events.groupBy("conv_id", "message_id", "copy").agg(F.sort_array(F.collect_list(event)).alias("log"))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*RESETS), i).otherwise(0)))
    ruled = grouped.withColumn("since", last).withColumn("live", F.slice("log", F.col("since") + 1, F.size("log")))
    return ruled.where(F.get("live", F.lit(0))["kind"] != "delete").select(
        "conv_id", "message_id", "copy",
        F.get("log", F.lit(0))["seq"].alias("first_seq"),
        F.get("log", F.lit(0))["role"].alias("role"),
        F.array_join(F.transform("live", lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """messages: conv_id, message_id, copy, first_seq, role, text. Returns conv_id, formatted and loss_spans: start (from
    1) and length, in code points of formatted, of each assistant text, in order."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    own = messages.select("conv_id", F.struct("first_seq", "message_id", "copy", F.char_length(head).alias("head"), F.char_length(body).alias("body"), (F.col("role") == "assistant").alias("loss"), F.concat(head, body, F.lit(END + "\n")).alias("part")).alias("m"))
    turns = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    tail = len(END) + 1
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "ms", start,
        lambda s, m: F.struct(
            (s["at"] + m["head"] + m["body"] + tail).alias("at"),
            F.when(m["loss"], F.array_append(s["spans"], F.struct((s["at"] + m["head"]).alias("start"), m["body"].alias("length")))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return turns.select("conv_id", F.array_join(F.transform("ms", lambda m: m["part"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> out of a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    blocks = F.slice(pieces, 2, F.size(pieces) - 1)  # nothing stands before the first turn
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substring(b, F.locate("\n", b) + 1, F.char_length(b) - F.locate("\n", b) - (len(END) + 1))).alias("text"),
        ),
    )


def message_log(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log of ``message`` events, one for each row; equal turns are told apart by role and text."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return rows.select("conv_id", F.col("turn").alias("message_id"), place.alias("copy"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def format_log(events: DataFrame) -> DataFrame:
    return render(fold(events))
