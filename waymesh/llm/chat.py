"""Chat formatting by perspective rotation: every participant speaks once as the assistant.

For each participant of a conversation the dialogue is rendered with that speaker as the
assistant and the others as named users; the mask tells which characters are the assistant's, the
ones to train on. Roles in ``context_roles`` are no participants: their turns are
rendered as they are in every perspective and never masked in.

Turns are numbered with a range partitioning over conversation *and* order, so a conversation
of any size spreads over many tasks, and rendered in parts of ``part_turns`` turns: a row is one
(conversation, perspective, part). A conversation of at most ``part_turns`` turns is one row; a
longer one continues in the next part, with nothing left out. The mask counts characters from the
beginning of the part.

Defined results: a null text is empty, a null role is the participant ``unknown``; turns with equal
numbers follow each other by role and text; repeated rows are turns of their own; rows
without a conversation id form one conversation. The opening of a marker that occurs in a text or a
role is written with a blank, so texts cannot forge turns. A conversation of context turns only has no
perspective and gives no row. Other columns play no part. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.operators.steps import ordered_steps

PART_TURNS = 512
CONTEXT_ROLES = ("system",)


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    part_turns: int = PART_TURNS, context_roles: tuple[str, ...] = CONTEXT_ROLES,
) -> DataFrame:
    """``conv, perspective, part, n_turns, rendered, mask``; mask is ``start:end`` pairs, comma-joined."""
    said = turns.select(
        F.coalesce(F.col(f"`{conv}`"), F.lit(0)).alias("conv"), F.col(f"`{conv}`").isNull().alias("nameless"),
        F.coalesce(F.col(f"`{turn}`"), F.lit(-1)).alias("turn"),
        _safe(F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("unknown"))).alias("role"),
        _safe(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("body"),
    )
    keys = ["conv", "nameless"]
    numbered = ordered_steps(said, keys, ["turn", "role", "body"], "turn").withColumn("part", F.floor(F.col("pos") / part_turns))
    parts = numbered.groupBy(*keys, "part").agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "body"))).alias("turns")
    )
    speakers = said.filter(~F.col("role").isin(*context_roles)).select(*keys, F.col("role").alias("perspective")).distinct()
    seen = parts.join(speakers, keys)

    def piece(t: Column) -> Column:
        mine = t["role"] == F.col("perspective")
        head = F.when(mine, F.lit("<|assistant|>\n")).when(
            t["role"].isin(*context_roles), F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))
        ).otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))
        # the assistant's own words and the end of its turn are what is trained on
        tail = F.concat(t["body"], F.lit("<|end|>"))
        return F.struct(
            F.concat(head, tail, F.lit("\n")).alias("all"), F.length(head).alias("before"), F.length(tail).alias("words"),
            mine.alias("mine"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(done: Column, p: Column) -> Column:
        begin = done["at"] + p["before"]
        span = F.concat_ws(":", begin.cast("string"), (begin + p["words"]).cast("string"))
        return F.struct(
            (done["at"] + F.length(p["all"])).alias("at"),
            F.when(p["mine"], F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    rendered = seen.select(*keys, "perspective", "part", F.transform("turns", piece).alias("pieces"))
    return rendered.select(
        F.when(~F.col("nameless"), F.col("conv")).alias(conv), "perspective", "part",
        F.size("pieces").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["all"]), "").alias("rendered"),
        F.array_join(F.aggregate("pieces", start, add)["spans"], ",").alias("mask"),
    )
