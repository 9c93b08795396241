"""Shards by jump consistent hashing: a key and the number of shards decide, no ring table is kept.

The published algorithm (Lamping and Veach, 2014) jumps through the shard counts at which
a key would move; the last jump below the number of shards is its shard. With one more
shard a row either stays or moves into the new one, about one row in n + 1.

Native throughout: the 64-bit generator is written with 32-bit halves of built-in long
arithmetic, which never overflows, so it works under ANSI rules and stays in the JVM.

Law: ``key``. Defined results: a null id hashes like the id 0. Rows that agree in id, size
and checksum are interchangeable; each gets a slot of its own. Other columns play no part.
An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.llm.common import text_of, utf8_length
from waymesh.runtime import store

# fixed value: the multiplier of the published generator
_STEP = 2862933555777941757
_LOW = 0xFFFFFFFF

#: Rows (of distinct documents) that share a window when slots are numbered.
CHUNK_ROWS = 100_000


def next_random(state: Column) -> Column:
    """``state * _STEP + 1`` modulo 2**64, as a signed long."""
    c_low, c_high = _STEP & _LOW, _STEP >> 32
    low, high = state.bitwiseAND(_LOW), F.shiftrightunsigned(state, 32)

    def times(x: Column, c: int) -> tuple[Column, Column]:
        """The product of two 32-bit numbers as (part below 2**48, part to shift by 16)."""
        return x * F.lit(c & 0xFFFF), x * F.lit(c >> 16)

    a, b = times(low, c_low)
    bottom = a.bitwiseAND(_LOW) + F.shiftleft(b.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(a, 32) + F.shiftright(b, 16) + F.shiftright(bottom, 32)

    def modulo(x: Column, c: int) -> Column:
        p, q = times(x, c)
        return (p + F.shiftleft(q.bitwiseAND(0xFFFF), 16)).bitwiseAND(_LOW)

    top = (carry + modulo(low, c_high) + modulo(high, c_low)).bitwiseAND(_LOW)
    return F.shiftleft(top, 32).bitwiseOR(bottom.bitwiseAND(_LOW))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to ``shards`` - 1) of a long key.

    A jump moves at least one shard ahead, so ``shards`` steps always suffice; steps after the
    last jump change nothing.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    begin = F.struct(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")).alias("state"),
                     F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("ahead"))

    def jump(at: Column, _: Column) -> Column:
        state = next_random(at["state"])
        ahead = F.floor(
            (at["ahead"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(state, 33) + 1).cast("double"))
        ).cast("bigint")
        moved = F.struct(state.alias("state"), at["ahead"].alias("shard"), ahead.alias("ahead"))
        return F.when(at["ahead"] < shards, moved).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), begin, jump, lambda at: at["shard"]).cast("int")


def with_shard(rows: DataFrame, shards: int, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``rows`` with the shard of their key: one expression, no shuffle."""
    return rows.withColumn(name, jump_shard(F.col(f"`{key}`"), shards))


def number_in_shards(rows: DataFrame, by: list[str], shard: str = "shard", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2, … without gaps inside each shard.

    Equal rows are counted before anything moves and expanded at the end, so no key however
    frequent meets in one task. Distinct rows are dealt into chunks by hash; a window
    numbers inside a chunk, and the chunk totals (a few per shard) shift it.
    """
    counted = store(rows.groupBy(*by, shard).agg(F.count(F.lit(1)).alias("copies")))
    chunks = max(1, -(-counted.rows // chunk_rows))
    dealt = counted.df.withColumn("chunk", F.pmod(F.xxhash64(*by), F.lit(chunks)))
    zero = F.lit(0).cast("bigint")
    totals = dealt.groupBy(shard, "chunk").agg(F.sum("copies").alias("total")).select(
        shard, "chunk",
        F.coalesce(F.sum("total").over(Window.partitionBy(shard).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), zero)
        .alias("chunk_start"),
    )
    inside = Window.partitionBy(shard, "chunk").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("copies").over(inside), zero)).join(totals, [shard, "chunk"])
    first = F.col("chunk_start") + F.col("start")
    return placed.select(*by, shard, F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` for every row."""
    body = text_of(text)
    rows = docs.select(
        F.col(f"`{id}`").alias("id"), (utf8_length(body) + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    # the shard follows from the id, so it needs no place in the grouping before the rows are counted
    placed = number_in_shards(with_shard(rows, shards, "id"), ["id", "size", "text_crc32"])
    return placed.select(
        F.col("id").alias(id), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
        jump_shard(F.col("id"), shards + 1).alias("grown_shard"),
    )
