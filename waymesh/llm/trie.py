"""Prefix tree of conversations over minimal perfect hash tables of nodes.

Every conversation c is rebuilt: the first h turns of conversation c - c % 5, then its own turns after the
first h (h = unsigned crc32 of the decimal c, modulo 9). A node is a distinct sequence of first rebuilt turns,
known by a digest of 128 bits: the sum of the digests of (depth, role, text) in four lanes of 32 bits, so prefixes
come from running sums instead of a chain. Rows of one digest must agree in depth, last turn and parent, else an error is
raised, so a collision cannot pass unseen.

Shards hold the paths of some conversations over ``CHUNK`` depths, so neither a common first turn nor a
conversation of any length fills one. In a shard the distinct digests get slots by a minimal perfect hash whose
table of keys verifies every lookup; counts are scattered into flat arrays by slot and accumulated through the array
of parent slots, deepest nodes first. Two passes: the first gives members per node, which are merged over
shards; the second gives sums over subtrees, for which each node counts once, in the shard of its smallest
member. What a conversation has below a chunk enters the chunk's last node as a carried sum.

Defined results: a null role or text is empty. Rows without conv_id belong to no conversation and are left out. Turns
are ordered by turn (null first), then role, then text; repeated rows are turns of their own. ``%`` takes the sign
of the dividend. Other columns play no part. An empty table gives an empty one, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.operators.steps import ordered_steps
from waymesh.runtime import ship, store

#: Depths of one conversation in a shard, rows of a shard on average, and ids of a piece of a list of ends.
CHUNK, SHARD_ROWS, ENDS_SPAN = 1024, 20_000, 64

_LANES = ["d0", "d1", "d2", "d3"]
_ROOT = "0" * 32


def _shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes over."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, role, text`` (depth from 1) of the rebuilt conversations, and all ``conv_id``."""
    known = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # numbering splits a conversation of any length over range partitions
    placed = ordered_steps(known.withColumn("nothing", F.lit(0)), ["conv_id"], ["turn", "role", "text"], "nothing")
    turns = store(placed.select("conv_id", "pos", "role", "text")).df
    ids = store(
        turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
        .withColumns({"shared": _shared_turns(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % 5})
    ).df
    sizes = ids.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    plan = store(
        ids.join(sizes, "base", "left").withColumn("taken", F.least("shared", F.coalesce("base_own", F.lit(0).cast("bigint"))))
    ).df
    # the first eight turns at most, of at most five conversations
    heads = turns.filter("pos < 8").withColumnRenamed("conv_id", "base")
    first = plan.select("conv_id", "base", "taken").join(heads, "base").filter("pos < taken").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "role", "text"
    )
    rest = turns.join(plan.select("conv_id", "shared", "taken"), "conv_id").filter("pos >= shared").select(
        "conv_id", (F.col("pos") - F.col("shared") + F.col("taken") + 1).alias("depth"), "role", "text"
    )
    return first.unionByName(rest), ids.select("conv_id")


def _digest(lanes: list[Column]) -> Column:
    return F.format_string("%08x" * 4, *[lane % (1 << 32) for lane in lanes])


def paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation, chunk and node: ``conv_id, chunk, depth, digest, parent, turn_key, octets, top, last, goes_on``.

    A chunk begins with the node above it (``top``); only chunk 0 owns its top, the root. ``last`` marks the
    conversation's deepest node of the chunk, ``goes_on`` that a further chunk follows.
    """
    key = F.sha2(F.to_json(F.struct("depth", "role", "text")), 256)
    lanes = [F.conv(F.substring("turn_key", 8 * k + 1, 8), 16, 10).cast("bigint").alias(name) for k, name in enumerate(_LANES)]
    keyed = store(
        turns.select("conv_id", "depth", key.alias("turn_key"), F.octet_length("text").cast("bigint").alias("octets"))
        .select("*", *lanes, F.floor((F.col("depth") - 1) / CHUNK).cast("bigint").alias("chunk"))
    ).df
    zero = F.lit(0).cast("bigint")
    above = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = keyed.groupBy("conv_id", "chunk").agg(*[F.sum(c).alias(c) for c in _LANES], F.max("depth").alias("deepest")).select(
        "conv_id", "chunk", "deepest", *[F.coalesce(F.sum(c).over(above), zero).alias(f"{c}_above") for c in _LANES],
        F.lead("chunk").over(Window.partitionBy("conv_id").orderBy("chunk")).isNotNull().alias("goes_on"),
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumns({f"{c}_here": F.sum(c).over(inside) for c in _LANES}).join(chunks, ["conv_id", "chunk"])
    here = [F.col(f"{c}_above") + F.col(f"{c}_here") for c in _LANES]
    nodes = summed.select(
        "conv_id", "chunk", "depth", _digest(here).alias("digest"),
        _digest([x - F.col(c) for x, c in zip(here, _LANES, strict=True)]).alias("parent"), "turn_key", "octets",
        F.lit(False).alias("top"), (F.col("depth") == F.col("deepest")).alias("last"), "goes_on",
    )
    no_parent, nothing = F.lit(None).cast("string"), F.lit("")
    tops = chunks.filter("chunk > 0").select(
        "conv_id", "chunk", (F.col("chunk") * CHUNK).alias("depth"), _digest([F.col(f"{c}_above") for c in _LANES]).alias("digest"),
        no_parent.alias("parent"), nothing.alias("turn_key"), zero.alias("octets"), F.lit(True).alias("top"), F.lit(False).alias("last"),
        "goes_on",
    )
    roots = ids.join(chunks.filter("chunk = 0").select("conv_id", "goes_on"), "conv_id", "left").select(
        "conv_id", zero.alias("chunk"), zero.alias("depth"), F.lit(_ROOT).alias("digest"), no_parent.alias("parent"), nothing.alias("turn_key"),
        zero.alias("octets"), F.lit(False).alias("top"), F.col("goes_on").isNull().alias("last"), F.coalesce("goes_on", F.lit(False)).alias("goes_on"),
    )
    # depth 1 hangs on the root by the empty sum of its lanes
    return nodes.unionByName(tops).unionByName(roots)


class NodeTable:
    """A minimal perfect hash over distinct digests: level by level the keys that meet no other get their slots.

    ``slots`` gives the slot of each asked digest after comparing it with the key stored there.
    """

    def __init__(self, digests: np.ndarray):
        self._levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        keys, left, taken = _words(digests), np.arange(len(digests)), 0
        while len(left):
            size = 2 * len(left) + 1
            at = _mixed(keys[left], len(self._levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            # the rank of a taken place, counted from all levels above, is the slot: no gaps
            self._levels.append((size, alone, taken + np.cumsum(alone) - alone))
            taken += int(alone.sum())
            left = left[~alone[at.astype(np.int64)]]
            if len(self._levels) > 200:
                raise ValueError("digests are not distinct")
        self.keys = np.empty((len(digests), 2), dtype=np.uint64)
        self.keys[self._places(keys)] = keys

    def _places(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (size, alone, ranks) in enumerate(self._levels):
            at = (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            here = alone[at]
            found[left[here]] = ranks[at[here]]
            left = left[~here]
        return found

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that are not in the table."""
        if not len(digests) or not len(self.keys):
            return np.full(len(digests), -1, dtype=np.int64)
        keys = _words(digests)
        found = self._places(keys)
        known = (found >= 0) & (self.keys[found] == keys).all(axis=1)
        return np.where(known, found, -1)


def _words(digests: np.ndarray) -> np.ndarray:
    """Digests of 32 hexadecimal digits as pairs of 64-bit numbers."""
    return np.frombuffer(bytes.fromhex("".join(digests)), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of each key that differs from level to level."""
    odd = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    mixed = (keys[:, 0] ^ (keys[:, 1] * odd)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _accumulate(values: np.ndarray, parents: np.ndarray, depths: np.ndarray) -> None:
    """Add every slot to its parent's slot, deepest nodes first."""
    order = np.argsort(-depths, kind="stable")
    cuts = np.flatnonzero(np.diff(depths[order])) + 1
    for level in np.split(order, cuts):
        level = level[parents[level] >= 0]
        np.add.at(values, parents[level], values[level])


_LOCAL = "shard int, digest string, parent string, depth long, turn_key string, octets long, top boolean, members long, conv_id long, chunk long"


def _local_nodes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The distinct nodes of a shard's paths with the number and the smallest id of their members here."""
    if rows.empty:
        return pd.DataFrame({name.split()[0]: [] for name in _LOCAL.split(", ")})
    distinct = rows.drop_duplicates("digest")
    table = NodeTable(distinct["digest"].to_numpy())
    nodes = distinct.iloc[np.argsort(table.slots(distinct["digest"].to_numpy()))].reset_index(drop=True)  # by slot
    slot = table.slots(rows["digest"].to_numpy())
    n = len(nodes)
    facts = ["depth", "turn_key", "parent"]
    if not nodes[facts].iloc[slot].reset_index(drop=True).equals(rows[facts].reset_index(drop=True)):
        raise ValueError("two different prefixes have the same digest")
    parents = np.full(n, -1, dtype=np.int64)
    has = nodes["parent"].notna().to_numpy()
    parents[has] = table.slots(nodes["parent"].to_numpy()[has])
    if (parents[has] < 0).any():
        raise ValueError("a node's parent is not in its shard")
    depths = nodes["depth"].to_numpy()
    members = np.zeros(n, dtype=np.int64)
    ends = rows["last"].to_numpy()
    np.add.at(members, slot[ends], 1)
    _accumulate(members, parents, depths)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, rows["conv_id"].to_numpy())
    return pd.DataFrame({
        "shard": np.int32(key[0]), "digest": nodes["digest"], "parent": nodes["parent"], "depth": depths, "turn_key": nodes["turn_key"],
        "octets": nodes["octets"], "top": nodes["top"], "members": members, "conv_id": least, "chunk": np.int64(key[1]),
    })


_SUMS = "digest string, n_leaves long, saved long, parent_conv long"


def _subtree_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtrees of a shard's nodes, and the smallest member of their parents."""
    if rows.empty:
        return pd.DataFrame({name.split()[0]: [] for name in _SUMS.split(", ")})
    table = NodeTable(rows["digest"].to_numpy())
    slot = table.slots(rows["digest"].to_numpy())
    nodes = rows.iloc[np.argsort(slot)].reset_index(drop=True)
    parents = np.full(len(nodes), -1, dtype=np.int64)
    has = nodes["parent"].notna().to_numpy()
    parents[has] = table.slots(nodes["parent"].to_numpy()[has])
    sums = nodes[["leaf_here", "saved_here"]].to_numpy(dtype=np.int64)
    _accumulate(sums, parents, nodes["depth"].to_numpy())
    conv = nodes["conv_id"].to_numpy()
    above = pd.array(np.where(parents >= 0, conv[parents], 0), dtype="Int64")
    above[parents < 0] = pd.NA
    out = pd.DataFrame({"digest": nodes["digest"], "n_leaves": sums[:, 0], "saved": sums[:, 1], "parent_conv": above})
    return out[~nodes["top"].to_numpy()]


def ends_hashes(ends: DataFrame) -> DataFrame:
    """``digest, ends_sha256`` of ``digest, conv_id``: the hash of each digest's ids, ascending, comma-joined.

    Ids are joined in pieces of at most ``ENDS_SPAN`` neighbouring ids first; a digest's pieces then stream
    through one hash state in order, so a list of any length is never held.
    """
    span = F.floor(F.col("conv_id") / ENDS_SPAN)
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = ends.groupBy("digest", span.alias("span")).agg(F.array_join(ids, ",").alias("ids"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            done: dict[str, str] = {}
            for digest, ids in zip(batch["digest"], batch["ids"], strict=True):
                if digest != at:
                    if at is not None:
                        done[at] = state.hexdigest()
                    at, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame({"digest": list(done), "ends_sha256": list(done.values())})
        if at is not None:
            yield pd.DataFrame({"digest": [at], "ends_sha256": [state.hexdigest()]})

    ship(ends.sparkSession)
    return pieces.repartition("digest").sortWithinPartitions("digest", "span").select("digest", "ids").mapInPandas(
        stream, "digest string, ends_sha256 string"
    )


def conversation_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    ship(conversations.sparkSession)
    steps = store(paths(*rebuilt_turns(conversations)))
    shards = max(1, -(-steps.rows // shard_rows))
    # the five conversations that share first turns come together
    def shard_of(conv: Column) -> Column:
        return F.pmod(F.xxhash64(conv - conv % 5), F.lit(shards)).cast("int")

    local = store(
        steps.df.withColumn("shard", shard_of(F.col("conv_id"))).groupBy("shard", "chunk").applyInPandas(_local_nodes, _LOCAL)
    ).df
    merged = local.filter("NOT top").groupBy("digest").agg(
        F.sum("members").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("octets").alias("octets"), F.max("depth").alias("depth"),
        F.max("parent").alias("parent"),
        # equal digests of different shards must mean the same node too
        ((F.min("depth") != F.max("depth")) | (F.min("turn_key") != F.max("turn_key")) | (F.min("parent") != F.max("parent"))).alias("differs"),
    )
    checked = store(merged, collisions=F.count_if("differs"))
    if checked.stats["collisions"]:
        raise ValueError("two different prefixes have the same digest")
    children = checked.df.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    zero = F.lit(0).cast("bigint")
    nodes = store(
        checked.df.join(children, "digest", "left").select(
            "digest", "conv_id", "depth", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
            F.col("n_children").isNull().cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("octets")).alias("saved"),
            F.greatest(F.floor((F.col("depth") - 1) / CHUNK), F.lit(0)).cast("bigint").alias("own_chunk"),
            shard_of(F.col("conv_id")).alias("own_shard"),
        )
    ).df
    # what a conversation owns below a chunk enters at its last node there
    long_ones = steps.df.filter("last AND goes_on").select("conv_id", "chunk", F.col("digest").alias("at"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    owned = nodes.groupBy("conv_id", F.col("own_chunk").alias("chunk")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    carried = (
        long_ones.join(owned, ["conv_id", "chunk"], "full").filter("chunk IS NOT NULL")
        .select("at", "conv_id", "chunk", F.sum("leaf").over(below).alias("leaf"), F.sum("saved").over(below).alias("saved"))
        .filter("at IS NOT NULL AND leaf + saved > 0")
        .groupBy(shard_of(F.col("conv_id")).alias("shard"), "chunk", F.col("at").alias("digest"))
        .agg(F.sum("leaf").alias("leaf_below"), F.sum("saved").alias("saved_below"))
    )
    mine = (F.col("shard") == F.col("own_shard")) & (F.col("chunk") == F.col("own_chunk")) & ~F.col("top")
    placed = (
        local.select("shard", "chunk", "digest", "parent", "depth", "top")
        .join(nodes.select("digest", "conv_id", "leaf", "saved", "own_shard", "own_chunk"), "digest")
        .join(carried, ["shard", "chunk", "digest"], "left")
        .select(
            "shard", "chunk", "digest", "parent", "depth", "top", "conv_id",
            (F.when(mine, F.col("leaf")).otherwise(0) + F.coalesce("leaf_below", zero)).alias("leaf_here"),
            (F.when(mine, F.col("saved")).otherwise(0) + F.coalesce("saved_below", zero)).alias("saved_here"),
        )
    )
    sums = placed.groupBy("shard", "chunk").applyInPandas(_subtree_sums, _SUMS).groupBy("digest").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("parent_conv").alias("parent_conv_id")
    )
    ended = ends_hashes(steps.df.filter("last AND NOT goes_on").select("digest", "conv_id"))
    return (
        nodes.drop("leaf", "saved").join(sums, "digest").join(ended, "digest", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    )
