"""Exact deduplication by progressive refinement: length, hash of the beginning, hash of the whole.

Every level groups only what the level before could not tell apart. Lengths and hashes
of the first ``prefix`` characters are cheap; the hash over the full content is computed
only for rows whose (length, prefix) group has at least two rows. Groups are counted
with map-side aggregation and joined back as the unique side, so one text held by a third of
all rows is never gathered in a task. What moves is a few numbers per row, never a text,
while the surviving groups are few enough to broadcast (counted first); beyond that the
texts shuffle once.

Defined results: a null text is an empty text, and empty texts are copies of each other. A
null id comes before every other id. Of rows that agree in text *and* id exactly one
stays. Other columns, whatever their names, play no part. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import text_of, utf8_length
from waymesh.runtime import small, store

#: Characters of the text that the second level hashes.
PREFIX = 64


def _twice(rows: DataFrame, *by: str) -> DataFrame:
    """The groups of at least two rows."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1").select(*by)


def suspects(docs: DataFrame, text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """``(length, head)`` groups that may hold copies: the first two levels."""
    body = text_of(text)
    measured = docs.select(utf8_length(body).alias("length"), F.xxhash64(F.left(body, F.lit(prefix))).alias("head"))
    pairs = store(measured.groupBy("length", "head").agg(F.count(F.lit(1)).alias("n_rows"))).df
    lengths = pairs.groupBy("length").agg(F.sum("n_rows").alias("all_rows")).filter("all_rows > 1").select("length")
    return pairs.filter("n_rows > 1").join(lengths, "length", "left_semi").select("length", "head", F.lit(True).alias("again"))


def _measured(rows: DataFrame, prefix: int) -> DataFrame:
    return rows.withColumns({"length": utf8_length(F.col("body")), "head": F.xxhash64(F.left("body", F.lit(prefix)))})


def _third_level(rows: DataFrame, text: str, prefix: int) -> DataFrame:
    """``rows`` (a struct ``row`` and ``body``) with ``length`` and, for suspects only, the ``full`` hash."""
    groups = small(suspects(rows.select(F.col("body").alias(text)), text, prefix))
    return _measured(rows, prefix).join(groups, ["length", "head"], "left").withColumn(
        "full", F.when(F.col("again"), F.sha2(F.col("body"), 256))
    )


def exact_groups(
    docs: DataFrame, id: str = "doc_id", text: str = "text", prefix: int = PREFIX, carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept`` and the ``carry`` columns.

    ``keep_id`` is the largest id of the rows with the same text. ``carry`` holds
    expressions over ``body``, the text without nulls, computed on the way.
    """
    carry = carry or {}
    rows = docs.select(F.struct(F.col(f"`{id}`").alias("id")).alias("row"), text_of(text).alias("body"))
    levels = _third_level(rows, text, prefix).select(
        F.col("row.id").alias("id"), "length", "full", *[c.alias(f"carry_{n}") for n, c in carry.items()],
        F.monotonically_increasing_id().alias("uid"),
    )
    seen = store(levels).df
    groups = (
        seen.filter("full is not null").groupBy("length", "full")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "uid")).alias("stays"))
    )
    alone = seen.filter("full is null").withColumns({
        "keep_id": F.col("id"), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True),
    })
    shared = seen.filter("full is not null").join(groups, ["length", "full"]).withColumns({
        "keep_id": F.col("stays.id"), "kept": F.col("uid") == F.col("stays.uid"),
    })
    out = [F.col("id").alias(id), "keep_id", "group_size", "kept", *[F.col(f"carry_{n}").alias(n) for n in carry]]
    return alone.select(*out).unionByName(shared.select(*out))


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """``docs`` with one row of every text, the one with the largest id; all columns stay.

    Rows outside the suspect groups pass straight through. Of the others one row per text is
    chosen with map-side aggregation, so copies are folded before they move.
    """
    alone, chosen = alone_and_chosen(docs, id, text, prefix)
    return alone.unionByName(chosen)


def alone_and_chosen(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> tuple[DataFrame, DataFrame]:
    """The two parts of :func:`drop_copies`: rows outside the suspect groups, and one row per text of the others.

    Who uses the result several times may write the second part, so that copies are folded only once.
    """
    fields = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(fields.alias("row"), text_of(text).alias("body"))
    marked = _measured(rows, prefix)
    groups = small(suspects(rows.select(F.col("body").alias(text)), text, prefix))
    alone = marked.join(groups, ["length", "head"], "left_anti").select("row.*")
    again = marked.join(groups, ["length", "head"], "left_semi").withColumn("full", F.sha2(F.col("body"), 256))
    # every other column takes part in the order, so the choice among equal ids is the same each time
    order = F.struct(F.col(f"row.`{id}`").alias("id"), F.xxhash64("row").alias("tie"), F.col("row").alias("row"))
    chosen = again.groupBy("length", "full").agg(F.max(order).alias("best"))
    return alone, chosen.select("best.row.*")
