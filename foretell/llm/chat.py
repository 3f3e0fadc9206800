"""Event-sourced chat formatting: fold message events into final messages, then render conversations.

A log has streamed deltas, edits and regenerations. Events are partitioned by
conversation and message, ordered by sequence and folded: the last event that
sets a message's text, and the deltas after it, make the final text. Messages
are rendered as marked turns; control strings inside texts are escaped so that
what is read back is exactly what went in. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of events: these set a message's text, a delta adds to it, a deletion removes the message.
SETS, DELTA, DELETE = ["open", "edit", "regenerate"], "delta", "delete"
#: A turn is <turn role="R">TEXT</turn> and a line end. No text holds "<", so no text can hold or break a mark.
OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"
#: Escapes in the order of writing; reading undoes them in the opposite order. After a written backslash there
#: is always one of the digits, so no two escapes overlap.
ESCAPES = [("\\", "\\0"), ("<", "\\1")]
ROLE_ESCAPES = [*ESCAPES, ('"', "\\2")]
#: The role whose texts are trained on.
LOSS_ROLE = "assistant"


def escape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, written in pairs:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, written in reversed(pairs):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def events_of(conversations: DataFrame) -> DataFrame:
    """A log that opens each row of ``conversations (conv_id, turn, role, text)`` as a message and streams its text.

    Rows that share a turn are messages of their own, ordered by role and text.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("nth", F.row_number().over(order))
    events = F.array(F.struct(F.lit(0).alias("seq"), F.lit("open").alias("kind"), F.lit("").alias("text")), F.struct(F.lit(1).alias("seq"), F.lit(DELTA).alias("kind"), F.col("text").alias("text")))
    message = F.struct(F.col("turn").cast("long").alias("turn"), "nth").alias("message")
    return rows.select("conv_id", message, "role", F.explode(events).alias("e")).select("conv_id", "message", "role", F.col("e.seq").cast("long").alias("seq"), "e.kind", "e.text")


def live_log(conversations: DataFrame) -> DataFrame:
    """A log of the same messages as they come about in a live chat: the fold of it is ``conversations``.

    Four kinds of messages take turns by a hash of their place: streamed in
    three deltas; a wrong draft that an edit replaces once the conversation has
    gone on; an answer that is streamed, discarded and regenerated; one that
    stands next to a message that is written and deleted. ``seq`` runs over the
    whole conversation, by turn, and later edits come after all turns.
    """
    told = events_of(conversations).where("seq = 1").select("conv_id", "message", "role", "text")
    text, third = F.col("text"), F.greatest(F.floor(F.length("text") / 3), F.lit(1)).cast("int")
    parts = [F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substring(text, 2 * third + 1, F.length(text))]
    place = F.coalesce(F.col("message.turn"), F.lit(-1)) * 65536 + F.col("message.nth") * 16
    late = F.lit(1 << 60)

    def event(step: int, kind: str, what: Column, after: Column = place, other: bool = False) -> Column:
        message = F.struct(F.col("message.turn").alias("turn"), (F.col("message.nth") + (1 << 20) * other).alias("nth"))
        role = F.when(F.lit(kind in SETS), F.col("role"))
        return F.struct(message.alias("message"), role.alias("role"), (after + step).cast("long").alias("seq"), F.lit(kind).alias("kind"), what.alias("text"))

    deltas = lambda at: [event(at + k, DELTA, p) for k, p in enumerate(parts)]
    wrong = F.concat(F.lit("draft: "), F.upper(text))
    kinds = [
        [event(0, "open", F.lit("")), *deltas(1)],
        [event(0, "open", wrong), event(1, "edit", parts[0], late + place), event(2, DELTA, parts[1], late + place), event(3, DELTA, parts[2], late + place)],
        [event(0, "open", F.lit("Well")), event(1, DELTA, F.lit(", no: ")), event(2, DELTA, wrong), event(3, "regenerate", F.lit("")), *deltas(4)],
        [event(0, "open", parts[0]), event(1, DELTA, parts[1]), event(2, DELTA, parts[2]), event(3, "open", wrong, other=True), event(4, "delete", F.lit(""), other=True)],
    ]
    kind = F.pmod(F.xxhash64("conv_id", "message"), F.lit(4))
    events = F.when(kind == 0, F.array(*kinds[0]))
    for k in (1, 2, 3):
        events = events.when(kind == k, F.array(*kinds[k]))
    return told.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """``(conv_id, message, role, text)``: the final messages of a log ``(conv_id, message, seq, kind, role, text)``.

    ``message`` names a message and orders it in its conversation. No event
    touches another message than its own, so folding each message's events by
    sequence gives what a walk through the whole conversation's log gives. A message's
    text is that of its last opening, edit or regeneration and of the deltas
    after it; without one, of all deltas. A message whose last event is a
    deletion is gone until it is set again. Its role is the last one given.
    Events with one seq count in the order of kind, then text, and repeated
    events count each time; a null text is empty, a null seq comes first.
    """
    sets = F.col("kind").isin(SETS + [DELETE])
    event = F.struct(F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"), "kind", F.coalesce("text", F.lit("")).alias("text"))
    # Keyed by message: a conversation of any length is folded in as many tasks as it has messages.
    logs = events.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(event)).alias("log"),
        F.max(F.when(sets, event)).alias("last"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("named"),
    )
    after = F.filter("log", lambda e: F.col("last").isNull() | (e > F.col("last")))  # deltas, all of them
    text = F.concat(F.coalesce("last.text", F.lit("")), F.array_join(F.transform(after, lambda e: e["text"]), ""))
    kept = logs.where(F.col("last").isNull() | (F.col("last.kind") != DELETE))
    return kept.select("conv_id", "message", F.coalesce("named.role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted)``: each conversation's turns in order of ``message``.

    A rendered conversation is one value, so its texts must fit into one row
    (2 GB) and, twice, into a task's memory; there is no other bound.
    """
    turn = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE))
    turns = messages.select("conv_id", F.struct("message", turn.alias("turn")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.array_join(F.col("t.turn"), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation as an array of ``(role, text)``."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def parse(part: Column) -> Column:
        at = F.instr(part, MIDDLE)
        role = F.substr(part, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substr(part, at + len(MIDDLE))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, parse)


def loss_spans(formatted: Column) -> Column:
    """``(start, end)`` of the texts under the loss mask, in code points of the rendered conversation, ends exclusive."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    mark = OPEN + LOSS_ROLE + MIDDLE

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct((acc["at"] + len(mark)).cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct((end + len(CLOSE)).cast("int").alias("at"), F.when(part.startswith(mark), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def format_conversations(conversations: DataFrame, log: Callable[[DataFrame], DataFrame] = events_of) -> DataFrame:
    """``(conv_id, formatted)`` for each conversation of ``conversations (conv_id, turn, role, text)``, rows by turn.

    ``log`` makes the events that are folded. Null texts and roles are empty;
    rows of one turn are ordered by role and text, repeated rows are repeated
    turns, a null turn comes first, a null conv_id is a conversation. Other
    columns are not read.
    """
    return render(fold(log(conversations)))
