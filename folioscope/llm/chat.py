"""Multi-party perspective rotation.

Each conversation is rendered once for every participant: that participant's
turns become the assistant's, everybody else's become a named user's, and only
the assistant's turns carry loss. Instructions (role ``system``) stay as they are
in every rendering and belong to nobody.

One row per (conversation, participant): the rendered text, the spans of it that
are trained on (``mask``: start and length in characters, in order), the number
of characters trained on, and the number of turns.

The dialogue is gathered per conversation, once, by (turn, then role, then text).
Where a turn begins with every speaker named is a running sum over the conversation; in
a rendering it begins earlier by what the assistant's headers before it are shorter, so the
spans need no pass over the text and the work grows with turns x speakers.

Defined cases
    * null role: an anonymous speaker named ``unknown``; null text: an empty turn.
    * null turn: before all others. Ties keep the order (role, text); repeated
      rows stay repeated.
    * null conversation id: each such row is a conversation of its own.
    * a conversation of system turns alone has no participant and so no row.
    * ``<|``, with which the format's control strings begin, becomes ``< |`` in a turn's text,
      so that no text can end a turn or begin one of somebody else's.
    * ``&``, ``<``, ``>`` and line ends would break a name's place in the format and become
      ``&amp;``, ``&lt;``, ``&gt;``, ``&#10;`` and ``&#13;``: other names stay other names.
    * extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the chat format.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;"))


def speaker_name(who: Column) -> Column:
    for mark, escaped in ESCAPES:
        who = F.replace(who, F.lit(mark), F.lit(escaped))
    return F.concat(F.lit("user name="), who)


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    c = conversations
    system = F.col("who").isin(list(system_roles))
    rows = c.select(c[conv_col].alias("conv_id"), c[turn_col].alias("turn"), F.coalesce(c[role_col], F.lit("unknown")).alias("who"), F.coalesce(c[text_col], F.lit("")).alias("said"))
    turns = rows.select(
        "conv_id", "turn", "who", "said", (~system).alias("speaks"), F.when(system, F.col("who")).otherwise(speaker_name(F.col("who"))).alias("name"),
        F.concat(F.replace("said", F.lit("<|"), F.lit("< |")), F.lit(TURN_END)).alias("body"),
    )
    head = lambda name: F.concat(F.lit(TURN_START), name, F.lit("\n"))
    length = F.length(head(F.col("name"))) + F.length("body")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "who", "said")
    at = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    turn = F.struct("k", "who", "speaks", "name", "body", "at")
    whole = turns.where("conv_id is not null").withColumns({"k": F.row_number().over(order), "at": at}).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    alone = turns.where("conv_id is null").withColumns({"k": F.lit(1), "at": F.lit(0).cast("long")}).select("conv_id", F.array(turn).alias("turns"))
    people = F.array_distinct(F.transform(F.filter("turns", lambda t: t["speaks"]), lambda t: t["who"]))
    each = whole.unionByName(alone).select("conv_id", "turns", F.explode(people).alias("perspective"))
    each = each.withColumn("own", F.filter("turns", lambda t: t["speaks"] & (t["who"] == F.col("perspective"))))

    def rendered(t: Column) -> Column:
        return F.concat(head(F.when(t["speaks"] & (t["who"] == F.col("perspective")), F.lit("assistant")).otherwise(t["name"])), t["body"])

    def span(t: Column, i: Column) -> Column:
        shorter = F.length(t["name"]) - len("assistant")
        return F.struct((t["at"] - i * shorter + F.length(head(F.lit("assistant")))).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length"))

    trained = F.array_join(F.transform("own", lambda t: t["body"]), "")
    return each.select(
        "conv_id", "perspective", F.array_join(F.transform("turns", rendered), "").alias("text"), F.transform("own", span).alias("mask"),
        F.length(trained).cast("long").alias("n_trained"), F.size("turns").cast("long").alias("n_turns"), trained.alias("trained"),
    )
