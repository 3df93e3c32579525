r"""Chat formatting by event sourcing, with DataFrame functions only.

A log of events (deltas, edits, regenerations) is partitioned by conversation and ordered by sequence; the
events of each message fold into its final text, and the messages render into one training string with a
loss mask over the assistant's texts.

Template: ``<s>``, then for each turn ``[INST]role\ntext[/INST]``, or ``text</s>`` if the role is
``assistant``. Control strings inside texts and roles get a backslash after their first character; strings
that already have some there get one more, so that the escape can be undone exactly.

Folding: ``delta`` appends its text, ``edit`` replaces the message's text, ``regenerate`` discards it and
starts anew from its own text. Messages stand in the order of their first event.

Defined results: a null text or role reads as empty, a null kind as ``delta``; events of equal sequence are
ordered by kind and text, messages of equal sequence by role and text; rows without a conversation form one
of their own (null); an empty log gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
LEARNED = "assistant"
_CONTROL = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*/?(?:s>|INST\]))"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2")


def _escape_role(c: Column) -> Column:
    """Roles hold no line feed either."""
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def turn_events(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of finished turns as a log: one delta for each row, which is a message of its own."""
    return turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("seq"), F.monotonically_increasing_id().alias("msg"),
                        F.lit("delta").alias("kind"), F.col(role).alias("role"), F.col(text).alias("text"))


def messages(events: DataFrame) -> DataFrame:
    """``(conv_id, msg, seq, role, text)``: the final message of each (conversation, message) in the log."""
    e = events.select("conv_id", "msg", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"),
                      F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "role")))
    folded = e.groupBy("conv_id", "msg").agg(log.alias("log"))
    # everything up to the last edit or regeneration is superseded
    last = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(0)))
    live = F.slice(F.col("log"), F.col("from") + 1, F.size("log"))
    return (folded.withColumn("from", last)
            .select("conv_id", "msg", F.col("log")[0]["seq"].alias("seq"), F.col("log")[0]["role"].alias("role"),
                    F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text")))


def render(msgs: DataFrame) -> DataFrame:
    """``(conv_id, formatted, pieces, loss_spans)``: the training string of each conversation; the pieces
    ``(piece, loss)`` that make it up; the code points ``[start, end)`` under the loss mask."""
    learned = F.col("role") == LEARNED
    m = msgs.withColumn("body", escape("text"))
    m = m.withColumn("piece", F.when(learned, F.col("body")).otherwise(
        F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"), F.col("body"), F.lit(CLOSE))))
    order = ["seq", "role", "text", "msg"]
    size = F.char_length("piece") + F.when(learned, len(END)).otherwise(0)
    m = (m.withColumn("end", F.sum(size).over(Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("start", F.lit(len(BEGIN)) + F.col("end") - size).withColumn("learned", learned))
    rows = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*order, "piece", "learned", "start"))).alias("rows"))
    piece = lambda c, loss: F.struct(c.alias("piece"), F.lit(loss).alias("loss"))
    pieces = F.flatten(F.transform("rows", lambda r: F.when(
        r["learned"], F.array(piece(r["piece"], True), piece(F.lit(END), False))).otherwise(F.array(piece(r["piece"], False)))))
    spans = F.transform(F.filter("rows", lambda r: r["learned"]), lambda r: F.struct(
        r["start"].alias("start"), (r["start"] + F.char_length(r["piece"])).alias("end")))
    return (rows.select("conv_id", F.concat(F.array(piece(F.lit(BEGIN), False)), pieces).alias("pieces"), spans.alias("loss_spans"))
            .select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "pieces", "loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns ``array<(role, text)>`` that a formatted string says."""
    body = F.substr(formatted, F.lit(len(BEGIN) + 1))
    found = F.regexp_extract_all(body, F.lit(r"(?s)\[INST\].*?\[/INST\]|.*?</s>"), F.lit(0))

    def turn(s: Column) -> Column:
        inner = F.substr(s, F.lit(len(OPEN) + 1), F.char_length(s) - (len(OPEN) + len(CLOSE)))
        role = F.substring_index(inner, "\n", 1)
        return F.when(F.startswith(s, F.lit(OPEN)), F.struct(
            _unescape_role(role).alias("role"), unescape(F.substr(inner, F.char_length(role) + 2)).alias("text"))).otherwise(
            F.struct(F.lit(LEARNED).alias("role"), unescape(F.substr(s, F.lit(1), F.char_length(s) - len(END))).alias("text")))

    return F.transform(found, turn)


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["piece"])), "")


def format_events(events: DataFrame) -> DataFrame:
    return render(messages(events))
