"""Chat formatting from event logs: fold each conversation's events into final messages, then render them.

Everything is DataFrame expressions.  A conversation becomes one string, so its messages meet in one row;
events are folded per message before that.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed values of the template.
START, END, MARK = "<|im_start|>", "<|im_end|>\n", "<|"
EVENTS = ["conv_id", "seq", "kind", "message_id", "role", "text"]


def fold_events(events: DataFrame) -> DataFrame:
    """``conv_id, position, role, text`` of the messages that a log leaves, from rows of ``EVENTS``.

    Kinds: ``message`` begins a message, ``delta`` adds to its text, ``edit`` replaces the text, ``regenerate``
    replaces the text and takes back all messages that began after this one and before the event, ``delete``
    takes the message back.  Events count in order of ``seq``; equal ones in order of kind and text.  A null
    text is empty, a null kind is a ``message``.  Deltas before any other event stand alone.  The role is that
    of the first event that has one, else empty.  ``position`` is a message's first ``seq``.
    """
    kind = F.coalesce("kind", F.lit("message"))
    log = events.select("conv_id", "seq", "message_id", "role", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    message = Window.partitionBy("conv_id", "message_id")
    at = F.struct("seq", "kind", "text")
    log = log.withColumns({"base": F.max(F.when(F.col("kind") != "delta", at)).over(message), "position": F.min("seq").over(message)})
    live = F.col("base").isNull() | (at >= F.col("base"))
    parts = F.array_sort(F.collect_list(F.when(live, at)))
    folded = log.groupBy("conv_id", "message_id").agg(
        F.min("position").alias("position"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))), F.lit("")).alias("role"),
        F.max("base")["kind"].alias("last"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    before = Window.partitionBy("conv_id").orderBy("position", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    taken_back = F.coalesce(F.max("again").over(before) > F.col("position"), F.lit(False))
    return (folded.withColumn("gone", taken_back).filter(~F.col("gone") & F.coalesce(F.col("last") != "delete", F.lit(True)))
            .select("conv_id", "position", "message_id", "role", "text"))


def escaped(text: Column) -> Column:
    """No control mark is left: each ``<|`` gets a second bar.  Undone by :func:`unescaped`."""
    return F.replace(text, F.lit(MARK), F.lit(MARK + "|"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit(MARK + "|"), F.lit(MARK))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(MARK + "n|>"))


def _role_back(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(MARK + "n|>"), F.lit("\n")))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask``: the text of each conversation, and the spans (``start``, ``length`` in
    code points) of the assistant's texts in it."""
    rows = messages.select("conv_id", F.struct("position", "message_id", _role(F.col("role")).alias("role"), escaped(F.col("text")).alias("text")).alias("m"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    head = lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"))
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        begin, size = acc["at"] + F.length(head(m)), F.length(m["text"])
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct((begin + size + len(END)).alias("at"), F.when(m["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return turns.select("conv_id", F.array_join(F.transform("m", lambda m: F.concat(head(m), m["text"], F.lit(END))), "").alias("formatted"),
                        F.aggregate("m", state, step)["spans"].alias("loss_mask"))


def turns_of(formatted: Column) -> Column:
    """The (role, text) turns read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    return F.transform(pieces, lambda p: F.struct(
        _role_back(F.substring_index(body(p), "\n", 1)).alias("role"),
        unescaped(F.substring(body(p), F.locate("\n", body(p)) + 1, F.length(p))).alias("text")))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def turn_events(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as a log of one ``message`` event each, in order of turn, then role and
    text; equal rows stay separate messages."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("seq"), F.lit("message").alias("kind"), "role", "text").withColumn("message_id", F.col("seq"))
