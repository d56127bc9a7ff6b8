"""Chat logs to training text: event-sourced reconstruction, then a template with a loss mask.

An event log holds, for each conversation, events in sequence: ``message`` opens a message, ``delta`` streams
more text to it, ``edit`` replaces its text, ``regenerate`` discards its text before it is streamed again.
Events are partitioned by conversation and turn, sorted by sequence and folded into messages. The messages
are rendered in parts of ``PART_TURNS`` turns, so no row holds a long conversation as a whole: a
conversation's text is its parts in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayspark.llm.common import between, let, pieces_of, running

#: The template's marks.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Turns that are rendered together.
PART_TURNS = 256

_MESSAGES = "array<struct<role:string,text:string>>"
_SPANS = "array<struct<start:bigint,length:bigint>>"

#: Kinds of events, in the order in which events of one seq apply; those up to the last set a text anew.
KINDS = ("message", "regenerate", "edit", "delta")
OPENS, RESETS, DELTA = 1, 2, 4


def escape(text: Column) -> Column:
    """No ``<|`` is left: a backslash goes between ``<`` and ``|``, one more where there are some already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``, and on one line."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Pairs of backslashes, from the left, are set aside, so none of them meets the n of a line end.
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turn, messages) from events (conv_id, turn, seq, event, role, text).

    Events of a turn apply in order of seq; ties apply by event, role and text, so any order of rows gives one
    result. Each ``message`` event is a message of its own, also where events of one turn repeat. A ``delta``,
    ``edit`` or ``regenerate`` before any message opens one with its role. Null texts and roles are empty;
    an event of another or no kind counts as ``message``. Null conv_id and turn are values like others, and
    come first. The events of a turn meet in one row. An empty table gives no rows.
    """
    kind = F.when(F.col("event").isin("delta", "edit", "regenerate"), F.col("event")).otherwise("message")
    order = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    rows = events.select(
        "conv_id",
        "turn",
        F.struct(
            F.col("seq").alias("seq"),
            order.alias("order"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("e"),
    )
    turns = rows.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return turns.select("conv_id", "turn", let(F.col("e"), _folded).cast(_MESSAGES).alias("messages"))


def _folded(events: Column) -> Column:
    """The messages of a turn's events in sequence."""
    places = F.transform(events, lambda e, i: F.when((e["order"] == OPENS) | (i == 0), i))
    heads = F.filter(places, lambda i: i.isNotNull())

    def message(run: Column) -> Column:
        # The fold's state is small, whatever was streamed: how many events, and the first whose text counts.
        begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("since"))
        step = lambda acc, e: F.struct((acc["at"] + 1).alias("at"), F.when(e["order"] < DELTA, acc["at"]).otherwise(acc["since"]).alias("since"))
        parts = lambda acc: F.transform(F.slice(run, acc["since"] + 1, F.size(run)), lambda e: F.when(e["order"] == RESETS, "").otherwise(e["text"]))
        text = F.aggregate(run, begin, step, lambda acc: F.array_join(parts(acc), ""))
        return F.struct(F.get(run, F.lit(0))["role"].alias("role"), text.alias("text"))

    def each(found: Column) -> Column:
        upto = F.concat(F.slice(found, F.lit(2), F.size(found)), F.array(F.size(events)))
        return F.zip_with(found, upto, lambda a, b: let(F.slice(events, a + 1, b - a), message))

    return let(heads, each)


def render(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, formatted, mask): the text of each part and the spans (start, length; code points in the
    part) that training scores: the texts of assistant messages.

    A part's number follows its turns; a null turn comes before all others. Null roles and texts are empty.
    An empty table gives no rows."""
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-(1 << 62))).cast("long")
    gathered = turns.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "messages"))).alias("t"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    pieces = F.transform(
        F.flatten(F.transform("t", lambda t: t["messages"])),
        lambda m: F.struct(
            F.concat(F.lit(OPEN), escape_role(empty(m["role"])), F.lit("\n")).alias("head"),
            escape(empty(m["text"])).alias("body"),
            (empty(m["role"]) == ASSISTANT).alias("scored"),
        ),
    )

    def made(x: Column) -> Column:
        sizes = F.transform(x, lambda m: F.length(m["head"]) + F.length(m["body"]) + len(CLOSE) + 1)
        span = lambda m, at: F.when(m["scored"], F.struct((at + F.length(m["head"])).cast("long").alias("start"), F.length(m["body"]).cast("long").alias("length")))
        return F.struct(
            F.array_join(F.transform(x, lambda m: F.concat(m["head"], m["body"], F.lit(CLOSE + "\n"))), "").alias("formatted"),
            F.filter(F.zip_with(x, running(sizes), span), lambda s: s.isNotNull()).cast(_SPANS).alias("mask"),
        )

    return gathered.select("conv_id", "part", let(pieces, made).alias("x")).select("conv_id", "part", "x.formatted", "x.mask")


def read_back(parts: DataFrame) -> DataFrame:
    """(conv_id, part, chars, messages, scored): messages and scored texts, unescaped, from rendered parts alone. An
    empty table gives no rows."""
    turns = F.transform(
        F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda t: t != ""),
        lambda t: F.struct(
            unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
            unescape(F.substring(t, F.instr(t, "\n") + 1, F.length(t) - F.instr(t, "\n") - len(CLOSE) - 1)).alias("text"),
        ),
    )
    scored = let(pieces_of(F.col("formatted")), lambda p: F.transform("mask", lambda s: unescape(between(p, s["start"], s["start"] + s["length"]))))
    return parts.select("conv_id", "part", F.length("formatted").cast("long").alias("chars"), turns.alias("messages"), scored.alias("scored"))


def digests(back: DataFrame) -> DataFrame:
    """One row per conversation. A digest covers a conversation as a whole, so its parts meet in one row, one
    string each; rows of a conversation do not. A null conv_id is a conversation, too; an empty table gives no rows."""
    rows = back.select(
        "conv_id",
        "part",
        "chars",
        F.size("messages").cast("long").alias("n"),
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("scored", "").alias("loss"),
    )
    whole = rows.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("part", "turns", "loss"))).alias("p"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns = F.array_join(F.transform("p", lambda p: p["turns"]), "")
    loss = F.array_join(F.transform("p", lambda p: p["loss"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
