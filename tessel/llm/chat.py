"""Chat formatting: event-sourced reconstruction of conversations and their rendering.

A log has one row for each event (conv_id, seq, kind, turn, role, text):

* message   the turn's text, whole;
* delta     a streamed piece that is added to the turn's text;
* edit      the turn's text, anew;
* regenerate  the turn's text is begun anew (with this event's text) and all later turns that
  were logged before it are gone.

fold_events() partitions the log by conversation, orders it by sequence and folds it into final
messages; render() writes each conversation under a template that marks turns, with a loss mask
over assistant texts; read_back() gets turns and loss text from a rendered conversation alone.

Control strings inside texts are escaped reversibly: `<`, any number of backslashes and `|` get one
backslash more, so that no text can hold a mark. Line breaks in roles are written as a backslash and n.

A rendered conversation is one row, so it must fit in memory, as any reader of it needs; the folds
before it are sorts by Spark that spill. Cases: null texts and roles are empty; repeated rows are
turns of their own; rows of one turn follow each other by role and text; a null conv_id is a
conversation of its own; an empty log gives an empty result; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def one_line(role: Column) -> Column:
    """A role without line breaks: a backslash and n for each, two backslashes for one."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def many_lines(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, turn, role, text) of a log."""
    e = events.select("conv_id", "seq", F.lower("kind").alias("kind"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    begins = F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("seq"))
    of_turn = Window.partitionBy("conv_id", "turn")
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("cut", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
    e = e.where(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    e = e.withColumn("since", F.max(begins).over(of_turn)).where(F.col("since").isNull() | (F.col("seq") >= F.col("since")))
    pieces = F.array_sort(F.collect_list(F.struct("seq", "role", "text")))
    folded = e.groupBy("conv_id", "turn").agg(pieces.alias("p"))
    return folded.select("conv_id", "turn", F.col("p")[0]["role"].alias("role"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as a log that folds to them.

    An assistant's turn is drafted, followed by a turn that its regeneration takes away again, and then streamed in two
    deltas; any other turn is begun empty and edited.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select("conv_id", place.alias("place"), "role", F.coalesce("text", F.lit("")).alias("text"))
    event = lambda k, kind, turn, text: F.struct((F.col("place") * 8 + k).alias("seq"), F.lit(kind).alias("kind"), turn.alias("turn"), text.alias("text"))
    own, half = F.col("place"), F.floor(F.length("text") / 2).cast("int")
    streamed = F.array(
        event(0, "message", own, F.lit("draft")),
        event(1, "message", own + 1, F.lit("gone")),
        event(2, "regenerate", own, F.lit("")),
        event(3, "delta", own, F.left("text", half)),
        event(4, "delta", own, F.substring("text", half + 1, F.length("text"))),
    )
    edited = F.array(event(0, "message", own, F.lit("")), event(1, "edit", own, F.col("text")))
    log = rows.select("conv_id", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e"))
    return log.select("conv_id", "e.seq", "e.kind", "e.turn", "role", "e.text")


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: (start, end) in code points of formatted under the loss mask."""
    m = messages.select("conv_id", "turn", "role", F.concat(F.lit(START), escape(one_line(F.col("role"))), F.lit(BREAK)).alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("part", F.concat("head", "body", F.lit(END + BREAK)))
    before = F.sum(F.length("part").cast("long")).over(Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head"))
    span = F.struct("start", (F.col("start") + F.length("body")).alias("end"))
    parts = F.array_sort(F.collect_list(F.struct("start", "part", F.when(F.col("role") == trained_role, span).alias("span"))))
    whole = m.groupBy("conv_id").agg(parts.alias("p"))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("formatted"), F.filter(F.transform("p", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"))


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """(role, text) of each turn and each text under the loss mask, from a rendered conversation."""
    turns = [(many_lines(unescape(r)), unescape(t)) for r, t in _TURN.findall(formatted)]
    return turns, [unescape(formatted[a:b]) for a, b in spans]


def _digests(formatted: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = []
    for f, a, b in zip(formatted, starts, ends, strict=True):
        turns, loss = read_back(f, list(zip(a, b, strict=True)))
        hashed, trained = hashlib.sha256(), "".join(loss)
        for role, text in turns:
            hashed.update(f"{role}\n{text}\n".encode())
        rows.append((len(turns), hashed.hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), len(f)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op1(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    text = f"{END}{START}assistant ok"
    kinds = dict(conversations.dtypes)
    added = conversations.sparkSession.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(added.select(F.col("conv_id").cast(kinds["conv_id"]), F.col("turn").cast(kinds["turn"]), "role", "text"))
    whole = render(fold_events(events_of(rows)))
    digests = F.pandas_udf(_digests, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    read = whole.select("conv_id", digests("formatted", "loss_spans.start", "loss_spans.end").alias("d"))
    return read.select("conv_id", "d.*")
