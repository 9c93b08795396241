"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

1. Texts that agree in their words are folded into one representative first, so copies
   however many count once.
2. A representative's MinHash signature is cut into bands; the band and row counts follow from the
   threshold and the recall wanted at it. Rows shuffle on the band hashes; only buckets
   of at least two representatives go on.
3. Members of a bucket that may match get to a common *block*: two rounds of handing the
   smallest member of a bucket on give neighbours one label, and a crowded label is dealt
   over blocks of bounded size. For every bucket all pairs of its blocks are formed, so no
   pair of its members is missed, whatever the labels; but within a block pair nothing is
   emitted per pair: the task compares the full n-gram sets there and returns a count of links per
   member and a spanning forest of the links.
4. Classes are the connected components of the verified links.

A representative has one block, so every pair of members is compared once. Numbers of links
include the copies: a row links to its own copies and to all rows of the representatives linked.

Words are runs of non-blank characters in lower case. Defined results: a text of fewer than
``n`` words is one n-gram of all its words; a text without words (or null) has no n-gram and is
a copy of every other such text, similar to nothing else. Equal rows are copies of each
other. A null id never names a class while the class has another id. Other columns play
no part. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import text_of
from waymesh.operators.components import connected_components
from waymesh.runtime import ship, small, store

#: Members of a block at most about this many; a block pair compares twice as many.
BLOCK = 128
#: n-grams (of all members together) that are laid out as a matrix at a time.
_MATRIX_COLUMNS = 4096
# fixed values: odd multipliers of a 64-bit polynomial hash and of a finalizer
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` values each that find a pair at the threshold with the recall wanted."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def joined_words(text: Column) -> Column:
    """The words of a text in lower case, with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def word_hashes(words: Column) -> Column:
    """64-bit hashes of the words of ``joined_words``."""
    return F.when(words == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(words, " "), lambda w: F.xxhash64(w))
    )


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The set of n-gram hashes, sorted."""
    h = hashes.astype(np.int64).view(np.uint64)
    if not len(h):
        return h
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        g = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            g = (g ^ h[i:len(h) - k + 1 + i]) * _BASE
            g ^= g >> np.uint64(29)
    return np.unique(g)


def signature(grams: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """One hash per band of the MinHash signature; piece by piece, so memory stays bounded."""
    draw = np.random.default_rng(seed)
    a = draw.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 2048):
            part = grams[at:at + 2048]
            mixed = (part ^ (part >> np.uint64(31))) * _MIX
            np.minimum(least, ((mixed[None, :] * a[:, None] + b[:, None]) >> np.uint64(8)).min(axis=1), out=least)
        key = np.arange(bands, dtype=np.uint64) * _MIX
        for r in range(rows):
            key = (key ^ least.reshape(bands, rows)[:, r]) * _BASE
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of parts of a 0/1 matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column) > 1  # an n-gram of one member is in no intersection
    keep = often[column]
    column, owner = (np.cumsum(often) - 1)[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    last = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, last, _MATRIX_COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + _MATRIX_COLUMNS])
        part = np.zeros((len(sets), min(_MATRIX_COLUMNS, last - first)), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        total += part @ part.T
    return total


def _forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Numbers of the links that join parts not joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    chosen = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            chosen.append(k)
    return chosen


def _compare(threshold: float):
    def work(members: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(g, dtype=np.int64).view(np.uint64) for g in members["grams"]]
        rep, block = members["rep"].to_numpy(), members["block"].to_numpy()
        copies = members["copies"].to_numpy()
        one = members["one"].iat[0]
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        common = intersections(sets)
        similar = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        np.fill_diagonal(similar, False)
        if (block != one).any():  # two blocks: pairs across only
            similar &= (block == one)[:, None] != (block == one)[None, :]
        links = similar @ copies.astype(np.float64)
        i, j = np.nonzero(np.triu(similar))
        tree = _forest(i, j)
        found = np.nonzero(links)[0]
        return pd.DataFrame({
            "u": np.concatenate([rep[found], rep[i[tree]]]),
            "v": np.concatenate([rep[found], rep[j[tree]]]),
            "links": np.concatenate([links[found].astype(np.int64), np.zeros(len(tree), dtype=np.int64)]),
        })

    return work


def _key(words: Column) -> Column:
    return F.unhex(F.md5(words.cast("binary")))


def _representatives(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Distinct ``key, id`` with their number of rows, and one row per key: ``key, rep, copies, first_id``."""
    pairs = store(
        docs.select(_key(joined_words(text_of(text))).alias("key"), F.col(f"`{id}`").alias("id"))
        .groupBy("key", "id").agg(F.count(F.lit(1)).alias("n_rows"))
    ).df
    reps = store(
        pairs.groupBy("key").agg(F.sum("n_rows").alias("copies"), F.min("id").alias("first_id"))
        .withColumn("rep", F.monotonically_increasing_id())
    ).df
    return pairs, reps


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of an Arrow column, as views of its buffer."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def _list_array(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int64()))


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(joined_words(text_of(text)).alias("words")).select(
        _key(F.col("words")).alias("key"), "words"
    )


def _signatures(docs: DataFrame, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """``key, bands`` of every row with words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(ngrams(h, n), bands, rows) for h in _lists(batch.column("hashes"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), _list_array(found)], ["key", "bands"])

    ship(docs.sparkSession)
    hashed = _hashed(docs, text).filter("words != ''").select("key", word_hashes(F.col("words")).alias("hashes"))
    return hashed.mapInArrow(work, "key binary, bands array<bigint>")


def _classes(
    docs: DataFrame, id: str, text: str, n: int, threshold: float, recall: float, rows: int, block: int
) -> DataFrame:
    """Distinct ``key, id, n_rows`` with ``class_id, class_key, n_links, n_copies, stays_key``."""
    pairs_of, reps = _representatives(docs, id, text)
    bands = bands_for(threshold, recall, rows)
    # a signature per text: copies give the same, any of them will do
    signed = _signatures(docs, text, n, bands, rows).groupBy("key").agg(F.first("bands").alias("bands"))
    banded = reps.join(signed, "key").select("rep", F.posexplode("bands").alias("band", "hash"))
    shared = banded.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("head")).filter("size > 1")
    members = store(banded.join(shared, ["band", "hash"]).select("rep", "band", "hash", "head")).df
    # neighbours get one label: the smallest member of their buckets, handed on once more
    near = members.groupBy("rep").agg(F.min("head").alias("label"))
    handed = (
        members.select("rep", "band", "hash").join(near, "rep").groupBy("band", "hash").agg(F.min("label").alias("label"))
    )
    labels = store(members.join(handed, ["band", "hash"]).groupBy("rep").agg(F.min("label").alias("label"))).df
    crowd = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    placed = store(labels.join(crowd, "label").select(
        "rep", F.xxhash64("label", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block")
    )).df
    # pairs of blocks that meet in a bucket, each once
    met = members.join(placed, "rep").groupBy("band", "hash").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    pairs = met.select(
        "blocks", F.explode("blocks").alias("one")
    ).select("one", F.explode(F.filter("blocks", lambda b: b >= F.col("one"))).alias("two")).distinct()
    # a block met in several pairs is compared with itself in its own pair only
    sides = store(pairs.select(
        "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block")
    )).df
    grams = _grams(docs, text, n, reps.join(placed, "rep").select("key", "rep", "copies", "block"))
    found = store(
        sides.join(grams, "block").groupBy("one", "two").applyInPandas(
            _compare(threshold), "u bigint, v bigint, links bigint"
        )
    ).df
    links = found.filter("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    classes = connected_components(found.filter("u != v").select("u", "v")).select(F.col("id").alias("rep"), "component")
    known = store(
        reps.join(links, "rep", "left").join(classes, "rep", "left")
        .select("key", "rep", "copies", "first_id", "links", F.coalesce("component", "rep").alias("component"))
    ).df
    names = known.groupBy("component").agg(
        F.min("first_id").alias("class_id"), F.min_by("key", F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("stays_key")
    )
    answer = known.join(names, "component").select(
        "key", "class_id", F.col("component").alias("class_key"), "stays_key",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"),
    )
    return pairs_of.join(answer, "key")


def similar_texts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8,
    recall: float = 0.999, rows: int = 8, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: ``id, class_id, class_key, n_links, n_copies``.

    ``class_id`` is the smallest id among the rows joined by links and copies; ``class_key`` tells
    classes apart even if ids repeat. ``n_links`` counts the other rows whose n-gram sets
    have at least the threshold's Jaccard similarity, the ``n_copies`` - 1 copies included. Pairs
    exactly at the threshold are found with ``recall``, closer ones almost surely.
    """
    found = _classes(docs, id, text, n, threshold, recall, rows, block)
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows")))
    return found.select(F.col("id").alias(id), "class_id", "class_key", "n_links", "n_copies", each.alias("nth")).drop("nth")


def _grams(docs: DataFrame, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """``block, rep, copies, grams`` of the texts wanted: one row per text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(h, n).view(np.int64) for h in _lists(batch.column("hashes"))]
            plain = ["block", "rep", "copies"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, plain), _list_array(found)], [*plain, "grams"])

    texts = _hashed(docs, text).join(wanted, "key").groupBy("rep", "block", "copies").agg(F.first("words").alias("words"))
    hashed = texts.select("block", "rep", "copies", word_hashes(F.col("words")).alias("hashes"))
    return hashed.mapInArrow(work, "block bigint, rep bigint, copies bigint, grams array<bigint>")


def one_per_class(
    docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8,
    recall: float = 0.999, rows: int = 8, block: int = BLOCK,
) -> DataFrame:
    """``docs`` with one row of every class, the one with the smallest id; all columns stay.

    What leaves is usually the smaller part, so its (key, id) pairs are counted and, if few
    enough, broadcast: then no text moves. Rows that repeat the id and the words of the one that
    stays are folded by an aggregation of their own.
    """
    columns = docs.columns
    found = store(_classes(docs, id, text, n, threshold, recall, rows, block).select(
        "key", "id", "n_rows", (F.col("key") == F.col("stays_key")).alias("first_text"), "class_id",
    )).df
    stays = F.col("first_text") & F.col("id").eqNullSafe(F.col("class_id"))
    again = small(found.filter(stays & (F.col("n_rows") > 1)).select("key", "id"))
    leaves = small(found.filter(~stays | (F.col("n_rows") > 1)).select("key", "id"))
    rows_of = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{id}`").alias("own"),
        _key(joined_words(text_of(text))).alias("mark"),
    )

    def same(other: DataFrame) -> Column:
        return (F.col("mark") == other["key"]) & F.col("own").eqNullSafe(other["id"])

    kept = rows_of.join(leaves, same(leaves), "left_anti").select("row.*")
    folded = (
        rows_of.join(again, same(again), "left_semi").groupBy("mark")
        .agg(F.max(F.struct(F.xxhash64("row").alias("tie"), "row")).alias("best")).select("best.row.*")
    )
    return kept.unionByName(folded)
