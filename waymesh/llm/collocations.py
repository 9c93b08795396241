"""Phrase collocations by a weighted de Bruijn graph of words.

Edges are the phrases of four words, nodes those of three: an edge leads from its first three words to its last
three. Each word of a text gives one row: the edge that begins with it, or, where none leaves (a piece ends), the shorter phrase
up to there. All shorter counts follow from the flow: a phrase occurs as often as edges leave it, plus the corrections
for pieces that end in or with it. Edges of candidates form paths; where a node has one edge in and one out they are
compacted into a single row of words and weights (list ranking gives the places), and candidates are read off
those rows.

A phrase that occurs ``least`` times has no rarer pair or triple of words in it, so an edge may be cut short where a pair or
triple is surely rarer, without changing any count that matters. Surely rarer means: the cell in a table of ``CELLS``
counters, of fixed size at any input, stays below ``least``: first for words and pairs, then for triples of frequent pairs.
Cells only err upwards (several phrases share one), so nothing is lost; with more data or fewer cells less is cut short,
and the result stays the same. Counters are summed block by block over the cluster; one bit per cell, 2 MB a table, is
sent to the tasks.

Words, pieces and counting in tasks are numpy and Arrow over slices of a few megabytes (a longer text comes
alone); phrases of a slice are counted before they move.

Defined results: a null text is empty, a null language is ``und``. Empty pieces count nothing. Texts are read as
bytes in UTF-8, only A-Z are lower-cased. Repeated rows count each time. Other columns play no part. An empty table, or
one without a frequent phrase, gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.operators.ranking import chain_places
from waymesh.runtime import ship, small, store

#: Least count of a phrase, phrases per language in the report, share (in hundredths) at which a longer phrase replaces a part.
LEAST, REPORT, COVERS = 30, 2000, 80
#: Counters of the table of pairs, in blocks; octets of text worked on at once; tables summed by one task.
CELLS, BLOCK, SLICE, FAN_IN = 1 << 24, 1 << 16, 4_000_000, 64
#: Edges of a compacted path per row, and parts that a common word's lookups are dealt into.
PATH_EDGES, SALT = 4096, 16

_KIND = np.zeros(256, dtype=np.uint8)  # 0 part of a word, 1 between words, 2 between pieces
_KIND[[32, 9]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts: ``ids`` into ``names``, the language and the text piece of each."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        kind = _KIND[raw]
        inside = kind == 0
        starts_text = np.zeros(len(raw) + 1, dtype=bool)
        starts_text[offsets] = True
        begins = inside & np.r_[True, ~inside[:-1]][:len(raw)] | inside & starts_text[:-1]
        at = np.flatnonzero(begins)
        letters = _LOWER[raw[inside]]
        ends = np.r_[(np.cumsum(inside) - 1)[at], len(letters)].astype(np.int32) if len(at) else np.zeros(1, dtype=np.int32)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(letters))
        coded = words.dictionary_encode()
        self.names = coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.searchsorted(offsets, at, side="right") - 1
        self.piece = np.cumsum(kind == 2)[at] + text if len(at) else np.zeros(0, dtype=np.int64)
        lang = langs.dictionary_encode()
        self.langs = lang.dictionary
        self.lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
        names = np.array(self.names.to_pylist(), dtype=object)
        self._hash = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, dtype=np.uint64)
        langs_named = np.array(self.langs.to_pylist(), dtype=object)
        self._lang_hash = pd.util.hash_array(langs_named, categorize=False) if len(langs_named) else np.zeros(0, dtype=np.uint64)

    def joined(self) -> np.ndarray:
        """For each word but the last: does the next one stand in the same piece?"""
        return self.piece[1:] == self.piece[:-1]

    def cells(self, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells of each word, of each word with the next one, and with the next two."""
        word, follower = self._hash[self.ids] ^ self._lang_hash[self.lang], self._hash[self.ids]
        pair = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + (follower[1:] * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1))
        triple = (pair[:-1] ^ (pair[:-1] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + follower[2:] * np.uint64(0xA0761D6478BD642F)
        return tuple(
            (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.int64) % cells
            for h in (word, pair, triple)
        )


def _slices(batch: pa.RecordBatch) -> Iterator[Words]:
    """The words of an Arrow batch of ``body, lang``, a few megabytes at a time."""
    sizes = np.cumsum(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + SLICE, side="right")))
        yield Words(batch.column("body").slice(begin, end - begin), batch.column("lang").slice(begin, end - begin))
        begin = end


def _unpacked(bits: bytes, cells: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8))[:cells].astype(bool)


def frequent_cells(bodies: DataFrame, least: int = LEAST, cells: int = CELLS, pairs: Broadcast | None = None) -> bytes:
    """One bit per cell, packed: did words and pairs of that cell occur ``least`` times? ``bodies``: ``body, lang``.

    With the bits of ``pairs`` it is triples that are counted, those whose pairs are both frequent.
    """
    if not 0 < least < 65536:
        raise ValueError("least must lie between 1 and 65535")
    kind = np.uint8 if least < 256 else np.uint16
    block = min(BLOCK, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, dtype=kind)
        frequent = None if pairs is None else _unpacked(pairs.value, cells)
        for batch in batches:
            for words in _slices(batch):
                single, pair, triple = words.cells(cells)
                if frequent is None:
                    seen = np.r_[single, pair[words.joined()]]
                else:
                    kept = words.joined() & frequent[pair]
                    seen = triple[kept[:-1] & kept[1:]]
                found, n = np.unique(seen, return_counts=True)
                table[found] = np.minimum(least, table[found] + np.minimum(n, least))
        part = TaskContext.get().partitionId()
        for k in range(0, cells, block):
            if table[k:k + block].any():
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([k // block], pa.int32()), "part": pa.array([part], pa.int64()),
                    "counts": pa.array([table[k:k + block].tobytes()], pa.binary()),
                })

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, dtype=np.uint32)
        for counts in frame["counts"]:
            total = np.minimum(least, total + np.frombuffer(counts, dtype=kind))
        return pd.DataFrame({"block": frame["block"].iloc[:1], "part": frame["part"].iloc[:1] // FAN_IN, "counts": [total.astype(kind).tobytes()]})

    schema = "block int, part long, counts binary"
    table = store(bodies.mapInArrow(count, schema), last=F.max("part"))
    parts = (table.stats["last"] or 0) + 1
    summed = table.df
    while True:  # sums of sums, so that no task gets more than FAN_IN tables of a block
        summed = summed.groupBy("block", F.floor(F.col("part") / FAN_IN)).applyInPandas(merged, schema)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    bits = np.zeros(-(-cells // 8), dtype=np.uint8)
    for row in summed.select("block", "counts").toLocalIterator():  # CELLS counters at most, whatever the input
        packed = np.packbits(np.frombuffer(row.counts, dtype=kind) >= least)
        bits[row.block * block // 8:][:len(packed)] = packed
    return bits.tobytes()


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct code stands first, and how often it occurs."""
    _, first, n = np.unique(codes, return_index=True, return_counts=True)
    return first, n


def _parts_of(words: Words, frequent: np.ndarray, triples: np.ndarray, cells: int) -> Iterator[pa.RecordBatch]:
    """For each word of a slice the longest phrase that begins with it and is not surely rare, counted by phrase."""
    n = len(words.ids)
    if not n:
        return
    single, pair, triple = words.cells(cells)
    two_fit = words.joined() & frequent[pair]
    three_fit = two_fit[:-1] & two_fit[1:] & triples[triple]
    size = frequent[single].astype(np.int32)
    size[:-1][two_fit] = 2
    size[:-2][three_fit] = 3
    size[:-3][three_fit[:-1] & three_fit[1:]] = 4
    # one code per (language, word), then per pair: exact, and below 2**62 for two pairs
    _, one = np.unique(words.lang * len(words.names) + words.ids, return_inverse=True)
    _, two = np.unique(one[:-1] * n + one[1:], return_inverse=True)
    for k in range(5):
        at = np.flatnonzero(size == k)
        if not len(at):
            continue
        codes = {0: lambda: words.lang[at], 1: lambda: one[at], 2: lambda: two[at], 3: lambda: two[at] * n + one[at + 2],
                 4: lambda: two[at] * n + two[at + 2]}[k]()
        _, first, count = np.unique(codes, return_index=True, return_counts=True)
        begin = at[first]
        grams = [words.names.take(pa.array(words.ids[begin + j])) for j in range(k)]
        joined = pc.binary_join_element_wise(*grams, " ") if k > 1 else grams[0] if k else pa.array([""] * len(begin))
        yield pa.RecordBatch.from_pydict({
            "lang": words.langs.take(pa.array(words.lang[begin])).cast(pa.string()), "gram": joined.cast(pa.string()),
            "size": pa.array(np.full(len(begin), k, dtype=np.int32)), "n": pa.array(count.astype(np.int64)),
        })


def graph_parts(bodies: DataFrame, least: int = LEAST, cells: int = CELLS) -> DataFrame:
    """``lang, size, gram, n``: edges of four words, and shorter phrases (down to none) where no edge leaves, over all texts."""
    context = bodies.sparkSession.sparkContext
    bits = context.broadcast(frequent_cells(bodies, least, cells))
    triple_bits = context.broadcast(frequent_cells(bodies, least, cells, bits))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, triples = _unpacked(bits.value, cells), _unpacked(triple_bits.value, cells)
        for batch in batches:
            for words in _slices(batch):
                yield from _parts_of(words, frequent, triples, cells)

    counted = bodies.mapInArrow(parts, "lang string, gram string, size int, n long")
    return counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _words_of(gram: str | Column, first: int, last: int) -> Column:
    """Words ``first`` to ``last`` (from 1) of a phrase."""
    return F.substring_index(F.substring_index(gram, " ", last), " ", first - last - 1)


def phrase_counts(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, size, phrase, f`` of all phrases of one to three words that occur ``least`` times: flow and corrections."""
    sizes = F.sequence(F.lit(1), F.least(F.col("size"), F.lit(3)))
    return (
        parts.filter("size > 0").select("lang", "gram", "n", F.explode(sizes).alias("size"))
        .groupBy("lang", "size", F.call_function("substring_index", F.col("gram"), F.lit(" "), F.col("size")).alias("phrase"))
        .agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    )


def compacted_paths(edges: DataFrame, path_edges: int = PATH_EDGES) -> DataFrame:
    """``lang, words, weights``: edges (``lang, gram, n``) joined through nodes with one edge in and one out.

    ``words`` has three words more than ``weights``. A path longer than ``path_edges`` gives several rows.
    """
    edges = store(edges.select(F.struct("lang", "gram").alias("id"), "n")).df
    lang, gram = F.col("id.lang"), F.col("id.gram")
    into = edges.groupBy(lang.alias("lang"), _words_of(gram, 2, 4).alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("id").alias("u"))
    out_of = edges.groupBy(lang.alias("lang"), _words_of(gram, 1, 3).alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("id").alias("v"))
    links = into.join(out_of, ["lang", "node"]).filter("ins = 1 AND outs = 1 AND u != v").select("u", "v")
    placed = edges.join(chain_places(links, edges.select("id")), "id")
    step = F.struct("place", gram.alias("gram"), "n")
    rows = placed.groupBy("chain", F.floor(F.col("place") / path_edges).alias("block")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    following = F.transform(F.slice("steps", 2, path_edges), lambda s: F.substring_index(s["gram"], " ", -1))
    return rows.select(
        F.col("chain.lang").alias("lang"), F.concat(F.split(F.col("steps")[0]["gram"], " "), following).alias("words"),
        F.transform("steps", lambda s: s["n"]).alias("weights"),
    )


def candidates(parts: DataFrame, frequent: DataFrame, least: int = LEAST, covers: int = COVERS) -> DataFrame:
    """``lang, size, phrase, a``: frequent phrases of two to four words that no longer frequent phrase stands for."""
    paths = compacted_paths(parts.filter((F.col("size") == 4) & (F.col("n") >= least)))
    windows = F.transform("weights", lambda n, k: F.struct(F.array_join(F.slice("words", k + 1, 4), " ").alias("phrase"), n.alias("a")))
    longest = paths.select("lang", F.lit(4).alias("size"), F.explode(windows).alias("w")).select("lang", "size", "w.phrase", "w.a")
    shorter = frequent.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    every = store(longest.unionByName(shorter)).df
    inside = F.when(
        F.col("size") == 4, F.array(*[_words_of("phrase", a, b) for a, b in ((1, 3), (2, 4), (1, 2), (2, 3), (3, 4))])
    ).when(F.col("size") == 3, F.array(*[_words_of("phrase", a, b) for a, b in ((1, 2), (2, 3))]))
    longer = every.filter("size > 2").select("lang", "a", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return every.join(longer, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (F.col("most").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * covers)
    ).select("lang", "size", "phrase", "a")


def collocations(
    docs: DataFrame, least: int = LEAST, report: int = REPORT, text: str = "text", lang: str = "lang", cells: int = CELLS
) -> DataFrame:
    """The first ``report`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score``."""
    ship(docs.sparkSession)
    bodies = docs.select(
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"),
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
    )
    parts = store(graph_parts(bodies, least, cells)).df
    frequent = store(phrase_counts(parts, least)).df
    totals = small(parts.groupBy("lang").agg(F.sum("n").alias("n")))  # one row for each word
    kept = store(candidates(parts, frequent, least)).df
    cuts = F.filter(
        F.array(*[
            F.struct(F.lit(k).alias("k"), _words_of("phrase", 1, k).alias("head"), F.call_function("substring_index", F.col("phrase"), F.lit(" "), k - F.col("size")).alias("tail"))
            for k in (1, 2, 3)
        ]),
        lambda c: c["k"] < F.col("size"),
    )
    cut = kept.select("lang", "size", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "size", "phrase", "a", "c.*")
    halves = F.array(F.struct(F.lit(True).alias("left"), F.col("head").alias("part")), F.struct(F.lit(False).alias("left"), F.col("tail").alias("part")))
    # a common word is a part of very many phrases: its lookups are dealt out
    alone = F.instr("part", " ") == 0
    asked = cut.select("lang", "phrase", "a", "k", F.explode(halves).alias("h")).select("lang", "phrase", "a", "k", "h.*").withColumn(
        "salt", F.when(alone, F.pmod(F.hash("phrase"), F.lit(SALT))).otherwise(0)
    )
    salts = F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    known = frequent.select("lang", F.col("phrase").alias("part"), "f", F.explode(salts).alias("salt"))
    scored = (
        asked.join(known, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k")
        .agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
        .withColumn("score", F.expr("(2000000 * CAST(a AS DECIMAL(28, 0))) div (CAST(l AS DECIMAL(28, 0)) + r)").cast("bigint"))
    )
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= report)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
