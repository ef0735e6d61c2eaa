"""Chat formatting from an event log, with DataFrame functions only.

A log row is (conv_id, turn, copy, seq, kind, role, text). Events of a message are folded in the order of seq: `open` names the role,
`delta` appends its text, `edit` replaces what is there by its text, `regenerate` discards it. Messages are folded apart
from each other, so a long conversation is shared among tasks until its final text is put together; then they are rendered:

    <|im_start|>role\\ntext<|im_end|>\\n

Inside a text, every `<`, backslashes, `|` gets one backslash more before the bar, so no `<|` is left and the step can be undone.
In a role, `%` and line breaks are written as %25 and %0A besides.

Defined cases: a null text is empty; null roles are empty names; turns sort with null first, and equal turns of a conversation sort by
role and text; repeated rows are turns of their own; a null conv_id is a conversation; an empty log gives no conversation;
further columns of the conversations do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import written

START, END = "<|im_start|>", "<|im_end|>\n"
_BAR, _ESCAPED = r"<(\\*)\|", r"<(\\*)\\\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _BAR, r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1|")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def event_log(conversations: DataFrame, chunk: int = 256) -> DataFrame:
    """A streamed log whose final messages are the given turns: deltas of at most `chunk` characters.

    Assistant turns begin with a draft that is regenerated; other turns begin with a wrong text that is edited.
    """
    ties = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    turns = turns.withColumn("copy", F.row_number().over(ties))
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    turns = turns.withColumn("parts", parts)
    first = F.coalesce(F.get("parts", F.lit(0)), F.lit(""))

    def event(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("text"))

    false_start = F.when(F.col("role") == "assistant", F.array(event("delta", F.reverse(first)), event("delta", F.lit("...")), event("regenerate", F.lit("")), event("delta", first)))
    false_start = false_start.otherwise(F.array(event("delta", F.upper(first)), event("edit", first)))
    rest = F.transform(F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1))), lambda p: event("delta", p))
    events = F.concat(F.array(event("open", F.lit(""))), false_start, rest)
    return turns.select("conv_id", "turn", "copy", "role", F.posexplode(events).alias("seq", "e")).select(
        "conv_id", "turn", "copy", "seq", "e.kind", F.when(F.col("e.kind") == "open", F.col("role")).alias("role"), "e.text")


def fold(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, copy, role, text. What stands before the last edit or regeneration does not count."""
    events = log.groupBy("conv_id", "turn", "copy").agg(
        F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))).alias("events"),
        F.max("role").alias("role"), F.coalesce(F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))), F.lit(-1)).alias("reset"))
    alive = F.filter("events", lambda e: (e["seq"] >= F.col("reset")) & e["kind"].isin("delta", "edit"))
    return events.select("conv_id", "turn", "copy", F.coalesce("role", F.lit("")).alias("role"),
                         F.array_join(F.transform(alive, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss_spans: start (from 0) and length of the assistant texts, in characters of formatted."""
    role, text = _role_out(F.col("role")), escape(F.col("text"))
    turns = messages.select("conv_id", "turn", "copy", (F.col("role") == "assistant").alias("learn"), role.alias("r"), text.alias("t"))
    turns = turns.withColumn("piece", F.concat(F.lit(START), "r", F.lit("\n"), "t", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "copy")
    before = F.coalesce(F.sum(F.length("piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("learn"), F.struct((before + len(START) + F.length("r") + 1).alias("start"), F.length("t").cast("bigint").alias("length")))
    turns = turns.select("conv_id", "turn", "copy", "piece", span.alias("span"))
    all_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "copy", "piece", "span"))).alias("turns"))
    return all_turns.select("conv_id", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
                            F.filter(F.transform("turns", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns from formatted texts: conv_id, place (from 1), role, text, and loss (the part of text under the mask, or null)."""
    parts = rendered.select("conv_id", F.posexplode(F.split("formatted", r"<\|im_start\|>")).alias("place", "part")).filter("place > 0")
    order = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    name = F.substring_index("part", "\n", 1)
    parts = parts.withColumn("name_chars", F.length(name)).withColumn(
        "at", F.coalesce(F.sum(F.length("part").cast("bigint") + len(START)).over(order), F.lit(0)) + len(START) + F.col("name_chars") + 1)
    body = F.substring("part", F.col("name_chars") + 2, F.length("part") - F.col("name_chars") - 1 - len(END))
    parts = parts.select("conv_id", "place", "at", _role_in(name).alias("role"), body.alias("body"))
    spans = rendered.select(F.col("conv_id").alias("of_conv"), F.explode("loss_spans").alias("s")).select("of_conv", "s.start", "s.length")
    both = parts.join(spans, parts["conv_id"].eqNullSafe(spans["of_conv"]) & (parts["at"] == spans["start"]), "left")
    loss = F.when(F.col("start").isNotNull(), unescape(F.substring("body", F.lit(1), F.col("length").cast("int"))))
    return both.select("conv_id", "place", "role", unescape(F.col("body")).alias("text"), loss.alias("loss"))


def digests(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    turns = read_back(rendered).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text", "loss"))).alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("turns", lambda x: F.coalesce(x["loss"], F.lit(""))), "")
    turns = turns.select(F.col("conv_id").alias("of_conv"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), learnt.alias("learnt"))
    sizes = rendered.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"))
    return sizes.join(turns, sizes["conv_id"].eqNullSafe(turns["of_conv"])).select(
        "conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def formatted(log: DataFrame) -> DataFrame:
    """Folds and renders a log; the table is written, so that readers do not fold it again."""
    return written(render(fold(log)), "chat-formatted")
