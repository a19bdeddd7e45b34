"""Chat formatting by event-sourced reconstruction, DataFrame functions only.

A log holds events (conversation, turn, sequence number, kind, role, text):

* ``message``    a turn's message, complete or the beginning of a stream,
* ``delta``      text to append to the turn's message,
* ``edit``       text that replaces what the message holds so far,
* ``regenerate`` drops what the message holds; text (if any) begins it anew.

Each conversation's events are sorted by sequence number (ties by turn, kind,
role, text; nulls first) and folded into messages by windows; a message is what
stands since its last message, edit or regenerate event, and its role is the
last non-null one.  Several message events on one turn are several messages.
Null texts and roles count as empty.  A table without rows gives none.

The rendered form of a message is ``<turn>role`` newline ``text</turn>`` newline.
Inside roles and texts a backslash becomes ``\\b`` and the ``<`` of ``<turn`` or
``</turn`` becomes ``\\l`` (in a role a newline becomes ``\\n``), so that no text
can look like a mark and every escape can be undone.

One shuffle, by conversation: the windows and the aggregate share it.  A whole
conversation is one row of the result, as is every format of this kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<turn>", "</turn>\n"
#: Turns of this role bear the loss.
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.regexp_replace(doubled, "<(?=/?turn)", r"\\l")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def as_events(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one message event each, by turn."""
    return rows.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, at (order in the conversation), role, text."""
    order = [F.col(c).asc_nulls_first() for c in ("seq", "turn", "kind", "role", "text")]
    of_turn = Window.partitionBy("conv_id", "turn").orderBy(*order)
    df = events.select("conv_id", "turn", "seq", "kind", "role", "text").repartition("conv_id")
    df = df.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    so_far = Window.partitionBy("conv_id", "turn").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("message", F.count_if(F.col("kind") == "message").over(so_far))
    starts = F.col("kind").isin("message", "edit", "regenerate")
    whole = Window.partitionBy("conv_id", "turn", "message")
    df = df.withColumn("last_start", F.max(F.when(starts, F.col("at"))).over(whole))
    parts = F.when(F.col("last_start").isNull() | (F.col("at") >= F.col("last_start")), F.struct("at", F.coalesce("text", F.lit("")).alias("text")))
    out = df.groupBy("conv_id", "turn", "message").agg(
        F.sort_array(F.collect_list(parts)).alias("parts"), F.min("at").alias("at"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role")
    )
    return out.select("conv_id", "turn", "at", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, and loss_spans, the
    (start, length) in code points, from 0, of the LOSS_ROLE texts in formatted.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    df = messages.select("conv_id", "at", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    df = df.withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head")
    df = df.withColumn("span", F.when(F.col("role") == LOSS_ROLE, F.struct(start.cast("bigint").alias("start"), F.length("body").cast("bigint").alias("length"))))
    out = df.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("at", "head", "body"))).alias("turns"), F.sort_array(F.collect_list("span")).alias("loss_spans"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return out.select("conv_id", "n_turns", text.alias("formatted"), "loss_spans")


def parsed(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of struct(role, text)."""
    pieces = F.split(formatted, CLOSE)  # after the last mark comes an empty piece
    body = lambda p: F.substring(p, len(OPEN) + 1, F.length(p))
    turn = lambda p: F.struct(unescape(F.substring_index(body(p), "\n", 1)).alias("role"), unescape(F.substring(body(p), F.length(F.substring_index(body(p), "\n", 1)) + 2, F.length(p))).alias("text"))
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, without separators."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
