"""Chat logs folded into final messages and rendered, in DataFrame functions only.

Events of a conversation come in order of ``seq``. Kinds: ``message`` (a whole text) and ``edit`` replace the text
of their turn, ``delta`` appends to it, ``regenerate`` drops the turn and all later turns logged before it, and
what follows is streamed anew. A NULL kind counts as message, a NULL seq comes first, as does a NULL turn, a NULL text or
role is empty; events of equal seq are folded in the order of turn, kind, role and text. Turns without any text event
are gone. The role of a turn is that of its last event. Conversations come out one row each, in order of turn.

Folding works on windows over the events (sorted and spilled by Spark), rendering on each message; only the
finished conversation is one value, as it must be. The template marks turns as

    <|im_start|>role, line end, text, <|im_end|>, line end

and escapes control strings inside texts reversibly: ``%`` becomes ``%25`` and ``<|`` becomes ``%3C|`` (a role's
line end becomes ``%0A`` too), so a mark can only come from the template.

NULL conv_ids form one conversation, further columns are ignored, repeated rows are events of their own, and
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    """Blanks of the escapes are taken back in the opposite order."""
    return unescape(F.replace(role, F.lit("%0A"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of events (conv_id, seq, kind, turn, role, text).

    ``part`` numbers messages that share a turn: a second ``message`` of a turn stands beside the first,
    an ``edit`` replaces the latest."""
    blank = F.lit("")
    e = events.select("conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"),
                      F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("seq", "turn", "kind", "role", "text")]
    back = [F.col(c).desc_nulls_last() for c in ("seq", "turn", "kind", "role", "text")]
    later = Window.partitionBy("conv_id").orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)
    # the lowest turn that a later event throws away
    e = e.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later))
    alive = e.where("(cut IS NULL OR turn IS NULL OR turn < cut) AND kind <> 'regenerate'")
    sofar = Window.partitionBy("conv_id", "turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    alive = alive.withColumn("part", F.sum((F.col("kind") == "message").cast("int")).over(sofar))
    # of one message, what counts starts at its last whole text
    after = Window.partitionBy("conv_id", "turn", "part").orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)
    alive = alive.withColumn("old", F.coalesce(F.max(F.col("kind") != "delta").over(after), F.lit(False))).where("NOT old")
    pieces = alive.groupBy("conv_id", "turn", "part").agg(
        F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in ("seq", "kind", "role", "text"))))).alias("e"))
    # whole text first, then the deltas in order
    first = F.array_join(F.transform(F.filter("e", lambda x: x["kind"] != "delta"), lambda x: x["text"]), "")
    rest = F.array_join(F.transform(F.filter("e", lambda x: x["kind"] == "delta"), lambda x: x["text"]), "")
    return pieces.select("conv_id", "turn", "part", F.element_at("e", -1)["role"].alias("role"), F.concat(first, rest).alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, and ``loss``: ranges (start, length in code points) of the texts of role ``learn``."""
    m = messages.select("conv_id", "turn", "part", "role",
                        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
                        escape(F.col("text")).alias("body"))
    m = m.withColumn("size", F.length("head") + F.length("body") + len(END) + 1)
    before = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.col("part").asc_nulls_first(), "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    loss = F.when(F.col("role") == learn, F.struct((F.col("at") + F.length("head")).alias("start"),
                                                   F.length("body").cast("long").alias("length")))
    whole = m.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END + "\n")).alias("text")))).alias("t"),
        F.array_sort(F.collect_list(loss)).alias("loss"))
    return whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("formatted"), "loss")


def parse(formatted: Column) -> Column:
    """The messages of a rendered conversation as an array of (role, text)."""
    turns = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.size(F.split(formatted, r"<\|im_start\|>")))

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(head) + 2, F.length(x) - F.length(head) - len(END) - 2)
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, turn)


def learned(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substring(formatted, x["start"].cast("int") + 1, x["length"].cast("int")))), "")
