"""Chat formatting with prefix-target expansion.

A conversation becomes one example for each of its assistant turns: all turns before it are the context, and only the
reply is trainable. A turn is written as ``<turn ROLE>``, a line feed, its text, ``</turn>`` and a line feed. In texts and roles each ``<``
becomes ``<_``, and in roles each ``>`` becomes ``<.``, so no text can hold a mark, and both are undone exactly. The trainable span is the
reply's text without the mark that closes it. Turns after the last reply make one more example, without a trainable span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("<_"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<_"), F.lit("<"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("<."))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<."), F.lit(">")))


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def expand(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length) from rows with conv_id, turn, role and text.

    ``formatted`` holds the context and the target; the trainable span counts characters from 0, and is NULL in an example of
    trailing turns. Turns are ordered by number, then role, then text. A NULL text or role is an empty one, a NULL turn
    number comes first, and NULL is a conversation of its own. Repeated rows are turns of their own; other columns are left
    out; an empty table gives an empty one. A conversation passes through one row, as each example needs all turns before it.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns")
    )
    pieces = F.transform("turns", lambda t: format_turn(t["role"], t["text"]))
    last = F.size("turns") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda k: (F.get("turns", k)["role"] == "assistant") | (k == last))
    spread = whole.select("conv_id", "turns", pieces.alias("pieces"), F.posexplode(ends).alias("example", "end"))
    target = F.get("turns", F.col("end"))
    is_reply = target["role"] == "assistant"
    context = F.array_join(F.slice("pieces", F.lit(1), F.col("end")), "")
    head = F.lit(len(OPEN) + len(MIDDLE)) + F.length(escape_role(target["role"]))
    return spread.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.concat(context, F.get("pieces", F.col("end"))).alias("formatted"),
        F.when(is_reply, F.length(context) + head).cast("long").alias("loss_start"),
        F.when(is_reply, F.length(escape(target["text"]))).cast("long").alias("loss_length"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    pieces = F.split(formatted, "</turn>\n")
    bodies = F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
    )

    def turn(body: Column) -> Column:
        role = F.substring_index(body, MIDDLE, 1)
        text = F.substring(body, F.length(role) + len(MIDDLE) + 1, F.length(body))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of the examples of each conversation, read from their formatted texts and trainable spans alone."""
    start, length = F.col("loss_start").cast("int"), F.col("loss_length").cast("int")
    loss = unescape(F.substring(F.col("formatted"), start + 1, length))
    spans = F.sort_array(F.collect_list(F.when(length.isNotNull(), F.struct("example", loss.alias("text")))))
    read = examples.groupBy("conv_id").agg(
        parse(F.max_by("formatted", "example")).alias("turns"),
        F.array_join(F.transform(spans, lambda s: s["text"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
