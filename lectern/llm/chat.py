"""Chat formatting with a verified round trip (native).

A turn is written as ``### role: text</turn>`` and a line break. The parser ends a turn at the end
mark, takes the role up to the first ``: `` and reads ``\\\\``, ``\\/`` and ``\\#`` as the second
character (in a role also ``\\.`` as a colon); it refuses bodies that still hold a mark. A turn is
first written as it is. If the parser does not give it back, it is escaped, after which no mark can
occur inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import text_or_empty

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
HEAD_MARK, END_MARK = "###", "</turn>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Doubles backslashes and breaks up every mark."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit(END_MARK), F.lit("<\\/turn>")), F.lit("#"), F.lit("\\#"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\."))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#])", "$1")


def unescape_role(role: Column) -> Column:
    """Pairs of backslashes are taken from the left, so what lies between them holds single ones only."""
    between = F.transform(F.split(role, r"\\\\", -1), lambda p: unescape(F.replace(p, F.lit("\\."), F.lit(":"))))
    return F.array_join(between, "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(MIDDLE), text, F.lit(END))


def _body(body: Column) -> tuple[Column, Column, Column]:
    """Role and text as written, and the number of code points before the text."""
    before = F.instr(body, MIDDLE) + F.lit(len(MIDDLE) - 1)
    role = F.substr(body, F.lit(len(HEAD) + 1), before - (len(HEAD) + len(MIDDLE)))
    return role, F.substr(body, before + 1), before


def _accepts(rendered: Column, role: Column, text: Column) -> Column:
    """Whether the parser reads exactly this one turn from its rendering."""
    pieces = F.split(rendered, END, 3)
    written_role, written_text, _ = _body(F.get(pieces, 0))
    unmarked = ~F.contains(written_text, F.lit(HEAD_MARK)) & ~F.contains(written_text, F.lit(END_MARK))
    return (
        (F.size(pieces) == 2)
        & (F.get(pieces, 1) == "")
        & unmarked
        & (unescape_role(written_role) == role)
        & (unescape(written_text) == text)
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, turns`` (the source turns in order).

    Input columns ``conv_id, turn, role, text``; others are not read. Turns are ordered by
    ``turn`` (null first), then role and text, so repeated rows stay repeated turns. Null role or
    text counts as empty; a null conversation is a conversation. Each turn is rendered and parsed
    back in its own row; only the joining of turns needs a conversation together, which its single
    output cell does anyway.
    """
    plain = turns.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    tried = plain.withColumn("as_is", render(F.col("role"), F.col("text")))
    escaped = render(escape_role(F.col("role")), escape(F.col("text")))
    settled = F.when(_accepts(F.col("as_is"), F.col("role"), F.col("text")), F.col("as_is")).otherwise(escaped)
    return (
        tried.select("conv_id", F.struct("turn", "role", "text", settled.alias("rendered")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select("conv_id", F.array_join("turns.rendered", "").alias("formatted"), "turns")
    )


def _bodies(formatted: Column) -> Column:
    pieces = F.split(formatted, END, -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Turns read from ``formatted``, one row each: ``conv_id, position, role, text, start, length``.

    ``start`` and ``length`` place the body text, as written, in the formatted text (code points);
    the spans of role ``assistant`` are the loss mask. Rows carry their own turn only.
    """
    turns = formatted.select("conv_id", F.posexplode(_bodies(F.col("formatted"))).alias("position", "body"))
    running = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    role, text, before = _body(F.col("body"))
    at = F.coalesce(F.sum(F.length("body") + len(END)).over(running), F.lit(0))
    return turns.withColumn("_at", at).select(
        "conv_id",
        "position",
        unescape_role(role).alias("role"),
        unescape(text).alias("text"),
        (F.col("_at") + before).alias("start"),
        (F.length("body") - before).alias("length"),
    )


def _parsed(body: Column) -> Column:
    role, text, _ = _body(body)
    return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Reads every conversation back and digests what was read, one row per conversation.

    ``round_trip`` says whether the recovered turns equal the source turns. The text under the loss
    mask is that of the recovered turns of role ``assistant``.
    """
    read = formatted.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.transform(_bodies(F.col("formatted")), _parsed).alias("read"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    said = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(F.filter("read", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"])
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(F.array_join(loss, "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(loss, ""), 256).alias("loss_sha256"),
        "formatted_chars",
        (F.col("read") == F.col("source")).alias("round_trip"),
    )
