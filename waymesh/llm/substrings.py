"""Repeated substrings: every byte under a string of ``length`` bytes that starts anywhere else goes.

Deep-shallow suffix sorting, dealt over the cluster by anchors:

1. Equal texts are folded. A text with copies is repeated as a whole; one of its rows stands for it.
2. The *anchor* of a window of ``length`` bytes is its smallest k-gram hash, the leftmost of
   equal ones. Equal windows have equal anchors at equal places, so only windows whose anchor hash occurs
   twice can repeat, and they can be told apart anchor by anchor. Neighbouring windows share
   anchors: about one number per 75 bytes is all that is counted.
3. The *context* of an anchor is the bytes of all its windows in a row. It travels as a hash first: the windows of a
   context that occurs again are repeated. Bytes are only cut out of the texts for anchors with several
   distinct contexts, once per distinct context.
4. The suffixes of the contexts of an anchor, one per window, are sorted to the depth of a window: by
   multikey quicksort on words of eight bytes to a shallow depth, then by blind tries for the
   groups whose members still agree. Suffixes that agree to the depth of a window are repeated.
   Tasks take whole anchors, many at a time. The windows of an anchor with very many distinct contexts
   are not sorted but counted by 16 bytes that stand for them, on the map side first.
5. The marks go back to the texts, and every row gets what is left of it.

Anchors that occur once and texts without anything to cut out or to remove stay where they are: tasks get one bit per cell of a
table of fixed size (`CELLS`, 8 MB at any input) and let through what falls into a cell that is taken. Where nearly
all cells are taken more is shuffled; the result stays the same.

Matches never cross texts; overlaps count; windows are judged on the input. Bytes are those of UTF-8.
Defined results: a null text is empty; a text shorter than ``length`` keeps all bytes. Equal rows are
copies of each other. Other columns play no part. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.llm.common import map_in_parts, slices, text_key, text_of, utf8_length
from waymesh.llm.exact import alone_and_chosen
from waymesh.runtime import ship, store

#: Length of the k-grams whose hashes choose anchors.
GRAM = 48
#: Bytes to which the multikey quicksort goes, a multiple of eight.
SHALLOW = 32
#: Distinct contexts of an anchor beyond which its windows are counted one by one.
CROWD = 5_000
#: Cells of a table of bits that tasks get, a power of two.
CELLS = 1 << 26
#: Runs or bytes of contexts that a task hands on at a time.
_RUNS, _CONTEXT_BYTES = 50_000, 4_000_000
#: Windows that are sorted at a time (those of one anchor together, however many they are).
_WINDOWS = 250_000
#: Bytes of text that are hashed at a time, no more than there are places (24 bits); hashing takes some 70 bytes a byte.
_CHUNK = 1_000_000
_PLACE = np.uint64(0xFFFFFF)
# fixed values: odd multipliers of a polynomial hash and its finalizer
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


# ---- anchors -----------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams of a byte array, by doubling."""
    value, have, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & have:  # put this power of two behind what is done
                if out is None:
                    out = value
                else:
                    n = len(value) - done
                    out = out[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + value[done:done + n]
                done += have
            if done == k:
                break
            value = value[:-have] * np.uint64(pow(_BASE, have, 1 << 64)) + value[have:]
            have *= 2
        out = out[:len(data) - k + 1]
        out = (out ^ (out >> np.uint64(31))) * _MIX
        return out ^ (out >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from minima to either end of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(texts: list[bytes], length: int) -> list[tuple[np.ndarray, ...]]:
    """Per text: anchor hash, first and last window start of every run of windows of one anchor."""
    gram = min(GRAM, length)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if sizes.sum() > int(_PLACE) + 1:  # more than there are places
        return [text_anchors(t, length) for t in texts]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < length:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))] * len(texts)
    hashes = gram_hashes(data, gram)
    least = sliding_min((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    # starts whose window lies within one text
    edge = np.zeros(len(least) + 1, dtype=np.int64)
    whole = np.nonzero(sizes >= length)[0]
    np.add.at(edge, begins[whole], 1)
    np.add.at(edge, ends[whole] - length + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    new[begins[whole]] = True
    first = np.nonzero(new)[0]
    owner = np.searchsorted(ends, first, side="right")
    nxt = np.append(first[1:], len(least))
    last = np.minimum(nxt - 1, ends[owner] - length)
    place = (least[first] & _PLACE).astype(np.int64)
    h = hashes[place].view(np.int64)
    cut = np.searchsorted(owner, np.arange(1, len(texts)))
    shift = begins[owner]
    return list(zip(
        np.split(h, cut), np.split((first - shift).astype(np.int32), cut), np.split((last - shift).astype(np.int32), cut), strict=True
    ))


def text_anchors(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """``anchors`` of one text of any size, chunk by chunk."""
    parts = []
    step = min(_CHUNK, int(_PLACE) + 2 - length)
    if step < 1:
        raise ValueError(f"windows of {length} bytes have more than {int(_PLACE) + 1} places")
    for at in range(0, max(1, len(text) - length + 1), step):
        h, first, last = anchors([text[at:at + step + length - 1]], length)[0]
        parts.append((h, first + at, last + at))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


# ---- deep-shallow sorting ------------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte words at every place of a byte array (zeros follow the end)."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | wide[k:k + len(data)]
    return out


def _regroup(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``order`` sorted by ``keys`` (most important first), and where a new class begins."""
    by = np.lexsort(keys[::-1])
    new = np.ones(len(by), dtype=bool)
    if len(by):
        new[1:] = np.logical_or.reduce([k[by][1:] != k[by][:-1] for k in keys])
    return order[by], new


def sort_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes within their groups, to ``depth`` bytes, and the class of each in that order.

    Suffixes of one class agree in the first ``depth`` bytes. Members that are alone in their
    class are settled and leave the work at once.
    """
    words = _words(data)
    n = len(starts)
    shallow = min(shallow, depth // 8 * 8)
    place = np.zeros(n, dtype=np.int64)  # the class of a suffix: number of suffixes in classes before it
    order, new = _regroup(np.arange(n), group)
    place[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    active = np.arange(n)
    at = 0
    # shallow: multikey quicksort, all classes at once, a word of eight bytes as a character
    while at < shallow and len(active):
        active = _split(place, active, words[starts[active] + at])
        at += 8
    # deep: blind tries, grown by one path a round: the class's first member is the path, every other member
    # leaves it where it first differs; those that leave at one place by one byte form a class
    reach = -(-(depth - at) // 8)
    while at < depth and len(active):
        heads = _first_of(place, active)
        common = _agreement(words, starts[active], starts[heads], at, reach, depth)
        apart = common < depth
        byte, path = np.zeros(len(active), np.int64), np.zeros(len(active), np.int64)
        byte[apart] = data[starts[active][apart] + common[apart]]
        path[apart] = data[starts[heads][apart] + common[apart]]
        side = np.where(apart, np.where(byte < path, 0, 2), 1)
        # before the path the ones that leave early come first, behind it last
        active = _split(place, active, side, np.where(side == 0, common, -common), byte)
        settled = _equal_to_head(words, starts, place, active, at, reach, depth)
        active = active[~settled]
    order = np.argsort(place, kind="stable")
    return order, place[order]


def _split(place: np.ndarray, active: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Refine the classes of ``active`` by ``keys``; what is still not alone."""
    order, new = _regroup(active, place[active], *keys)
    old = place[order]
    begins = np.nonzero(new)[0]
    number = np.cumsum(new) - 1
    # places run on within the old class
    start_of_old = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), np.arange(len(order)), 0)) if len(order) else begins
    place[order] = old + begins[number] - start_of_old
    sizes = np.diff(np.append(begins, len(order)))
    return order[sizes[number] > 1]


def _first_of(place: np.ndarray, active: np.ndarray) -> np.ndarray:
    """For every member the first member of its class."""
    _, first, back = np.unique(place[active], return_index=True, return_inverse=True)
    return active[first[back]]


def _agreement(words: np.ndarray, a: np.ndarray, b: np.ndarray, at: int, reach: int, depth: int) -> np.ndarray:
    """Length of the common prefix of suffixes known to agree in ``at`` bytes, at most ``depth``."""
    common = np.full(len(a), at, dtype=np.int64)
    left = np.arange(len(a))
    limit = len(words) - 1
    for k in range(reach):
        x = words[np.minimum(a[left] + at + 8 * k, limit)]
        y = words[np.minimum(b[left] + at + 8 * k, limit)]
        off = x ^ y
        same = off == 0
        common[left] += np.where(same, 8, 0)
        differ = off[~same]
        # equal leading bytes of the word in which they part
        lead = np.zeros(len(differ), dtype=np.int64)
        for shift in range(56, 0, -8):
            lead += (differ >> np.uint64(shift)) == 0
        common[left[~same]] += lead
        left = left[same]
        if not len(left):
            break
    return np.minimum(common, depth)


def _equal_to_head(words, starts, place, active, at, reach, depth) -> np.ndarray:
    """Whether a member's whole class is known to agree to the depth."""
    if not len(active):
        return np.zeros(0, dtype=bool)
    heads = _first_of(place, active)
    agree = _agreement(words, starts[active], starts[heads], at, reach, depth) >= depth
    _, back = np.unique(place[active], return_inverse=True)
    worst = np.ones(back.max() + 1, dtype=bool)
    np.logical_and.at(worst, back, agree)
    return worst[back]


def repeated_windows(contexts: list[bytes], windows: np.ndarray, group: np.ndarray, length: int) -> list[np.ndarray]:
    """Per context: which of its windows also stand in another context of its group."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    owner = np.repeat(np.arange(len(contexts)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, classes = sort_suffixes(data, begins[owner] + nth, group[owner], length)
    again = np.zeros(len(owner), dtype=bool)
    same = classes[1:] == classes[:-1]
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.split(again, np.cumsum(windows)[:-1])


# ---- on Spark ------------------------------------------------------------------------------------


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``key, body``: every text once. It is read several times, so copies are folded before: once, and only theirs are written."""
    bodies = docs.select(F.lit(0).alias("id"), text_of(text).alias("body"))
    alone, chosen = alone_and_chosen(bodies, "id", "body")
    return alone.unionByName(store(chosen).df).select(text_key(F.col("body")).alias("key"), "body")


def _taken(cells: DataFrame):
    """A filter from the column ``cell`` of a table, for cells below ``CELLS``: whether a value's cell is taken.

    The bits are put together over the cluster; their number does not depend on the table.
    """
    word = F.shiftright("cell", 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))").alias("bit")
    words = cells.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(CELLS // 64, dtype="<i8")
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = cells.sparkSession.sparkContext.broadcast(table.tobytes())

    @F.pandas_udf("boolean")
    def taken(cell: pd.Series) -> pd.Series:
        bits = np.frombuffer(sent.value, dtype=np.uint8)
        at = cell.to_numpy()
        return pd.Series((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return taken


def _cell(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(CELLS - 1).cast("bigint"))


def _with_keys(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts`` and ``found`` joined by ``key``; texts whose key is surely not there are not moved."""
    cell = _cell(F.xxhash64("key"))
    return texts.filter(_taken(found.select(cell.alias("cell")))(cell)).join(found, "key")


def _anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """Runs of windows of one anchor: ``key, h, c, first, windows``; ``c`` is a hash of the run's context."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, batch["body"], _CHUNK):
                bodies = [b.encode() for b in part["body"]]
                found = [text_anchors(bodies[0], length)] if len(bodies) == 1 else anchors(bodies, length)
                sizes = np.array([len(h) for h, _, _ in found])
                owner = np.repeat(np.arange(len(bodies)), sizes)
                h, first, last = (np.concatenate([f[k] for f in found]) for k in range(3))
                keys = part["key"].to_numpy()
                for at in range(0, len(h), _RUNS):
                    own, begin, end = owner[at:at + _RUNS], first[at:at + _RUNS], last[at:at + _RUNS]
                    digests = b"".join([
                        hashlib.md5(bodies[o][a:b]).digest()[:8] for o, a, b in zip(own.tolist(), begin.tolist(), (end + length).tolist(), strict=True)
                    ])
                    yield pd.DataFrame({
                        "key": keys[own], "h": h[at:at + _RUNS], "c": np.frombuffer(digests, dtype="<i8"), "first": begin, "windows": end - begin + 1,
                    })

    long_enough = texts.filter(utf8_length(F.col("body")) >= length)
    return map_in_parts(long_enough, work, "key binary, h bigint, c bigint, first int, windows int", _CHUNK)


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h, c, windows, members, context`` of the ``runs`` wanted of every ``key``."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["h", "c", "windows", "members", "context"]
        for batch in batches:
            for part in slices(batch, batch["body"]):
                rows, held = [], 0
                for body, runs in zip(part["body"], part["runs"], strict=True):
                    data = body.encode()
                    for run in runs:
                        context = data[run["first"]:run["end"]]
                        rows.append((run["h"], run["c"], run["windows"], run["members"], context))
                        held += len(context)
                        if held >= _CONTEXT_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    return map_in_parts(
        _with_keys(texts, wanted).select("body", "runs"), work, "h bigint, c bigint, windows int, members bigint, context binary", _CHUNK
    )


def _sorted_marks(contexts: DataFrame, by: list[str], length: int) -> DataFrame:
    """``h, c, runs`` of repeated windows, as (first, last), from contexts that share an anchor.

    Partitions are sorted by anchor, so a task meets every anchor whole, and sorts the suffixes of
    many anchors together.
    """
    def marks(part: pd.DataFrame) -> pd.DataFrame:
        keys = part.groupby(by, sort=False).ngroup().to_numpy()
        flags = repeated_windows(part["context"].tolist(), part["windows"].to_numpy(), keys, length)
        rows = []
        for h, c, flag in zip(part["h"], part["c"], flags, strict=True):
            step = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
            if len(step):
                rows.append((h, c, [{"a": int(a), "b": int(b) - 1} for a, b in zip(step[::2], step[1::2], strict=True)]))
        return pd.DataFrame(rows, columns=["h", "c", "runs"])

    def bounded(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        begins = np.append(True, np.logical_or.reduce([part[k].to_numpy()[1:] != part[k].to_numpy()[:-1] for k in by]))
        before = np.cumsum(part["windows"].to_numpy()) - part["windows"].to_numpy()
        bucket = np.maximum.accumulate(np.where(begins, before // _WINDOWS, 0))
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield marks(part.iloc[a:b])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            last = tuple(batch[k].iat[-1] for k in by)
            if tuple(held[0][k].iat[0] for k in by) == last:
                continue  # still one anchor
            whole = pd.concat(held, ignore_index=True)
            open_ = np.logical_and.reduce([whole[k].to_numpy() == v for k, v in zip(by, last, strict=True)])
            held = [whole[open_]]
            yield from bounded(whole[~open_])
        if held:
            yield from bounded(pd.concat(held, ignore_index=True))

    dealt = contexts.repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInPandas(work, "h bigint, c bigint, runs array<struct<a:int,b:int>>")


def _counted_marks(contexts: DataFrame, length: int) -> DataFrame:
    """The same marks by counting windows, for anchors with any number of contexts: no task holds an anchor or a window whole."""
    nth = F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("shift")
    window = F.substring(F.col("context"), F.col("shift") + 1, F.lit(length))
    windows = contexts.select("h", "c", "context", nth).select("h", "c", "shift", text_key(window).alias("w"))
    # two equal windows of an anchor lie in two contexts; counting "c" keeps the shuffle of the contexts the same for both uses
    again = windows.groupBy("h", "w").agg(F.count("c").alias("times")).filter("times > 1").select("h", "w")
    run = F.struct(F.col("shift").alias("a"), F.col("shift").alias("b"))
    return windows.join(again, ["h", "w"]).select("h", "c", F.array(run).alias("runs"))


def _joined(places: DataFrame, length: int) -> DataFrame:
    """``key, ranges``: window starts (``key, first, last``) with those put together whose bytes touch or overlap."""
    by = Window.partitionBy("key").orderBy("first", "last")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = places.withColumn("new", F.coalesce(F.col("first") > before + length, F.lit(True)).cast("int"))
    runs = new.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("key", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return whole.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))


def repeated_ranges(texts: DataFrame, length: int = 200, crowd: int = CROWD) -> DataFrame:
    """``key, ranges`` of the distinct ``texts`` with repeated windows: window starts as (first, last)."""
    ship(texts.sparkSession)
    table = store(_anchor_table(texts, length)).df
    twice = table.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    anchor = _cell(F.col("h"))
    met = store(table.filter(_taken(twice.select(anchor.alias("cell")))(anchor))).df
    # a context is known by its hash; one of its places stands for it
    distinct = store(met.groupBy("h", "c").agg(
        F.count(F.lit(1)).alias("times"), F.first("windows").alias("windows"), F.first(F.struct("key", "first")).alias("at")
    )).df
    sizes = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    compared = store(
        distinct.join(sizes, "h").select("h", "c", "windows", "members", "at.key", "at.first"), most=F.max("members")
    )
    end = (F.col("first") + F.col("windows") + (length - 1)).alias("end")
    wanted = store(
        compared.df.groupBy("key").agg(F.collect_list(F.struct("h", "c", "windows", "members", "first", end)).alias("runs"))
    ).df
    contexts = _contexts(texts, wanted)
    run = F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).alias("b"))
    equal = distinct.filter("times > 1").select("h", "c", F.array(run).alias("runs"))
    common = contexts.filter(F.col("members") <= crowd).select("h", "c", "windows", "context")
    marks = equal.unionByName(_sorted_marks(common, ["h"], length))
    if (compared.stats["most"] or 0) > crowd:
        marks = marks.unionByName(_counted_marks(contexts.filter(F.col("members") > crowd), length))
    placed = met.select("h", "c", "key", "first").join(marks, ["h", "c"]).select("key", "first", F.explode("runs").alias("r"))
    return _joined(placed.select("key", (F.col("first") + F.col("r.a")).alias("first"), (F.col("first") + F.col("r.b")).alias("last")), length)


def _copied(docs: DataFrame, text: str, length: int) -> DataFrame:
    """``key`` of the texts that stand in several rows and are long enough to be repeated as a whole."""
    keys = docs.select(text_key(text_of(text)).alias("key"), utf8_length(text_of(text)).alias("n"))
    return keys.filter(F.col("n") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1").select("key")


def _removed(ranges, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under repeated windows."""
    runs: list[tuple[int, int]] = []
    for first, last in sorted((r["first"], r["last"] + length) for r in ranges):
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], last))
        else:
            runs.append((first, last))
    return runs


def _without(texts: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """``key, n_removed, n_spans, kept`` of the texts that have ranges."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, batch["body"]):
                rows = []
                for key, body, found in zip(part["key"], part["body"], part["ranges"], strict=True):
                    data = body.encode()
                    runs, kept, at = _removed(found, length), [], 0
                    for begin, end in runs:
                        kept.append(data[at:begin])
                        at = end
                    kept.append(data[at:])
                    rows.append((key, sum(e - b for b, e in runs), len(runs), b"".join(kept)))
                yield pd.DataFrame(rows, columns=["key", "n_removed", "n_spans", "kept"])

    return map_in_parts(
        _with_keys(texts, store(ranges).df).select("key", "body", "ranges"), work,
        "key binary, n_removed bigint, n_spans bigint, kept binary", _CHUNK,
    )


def _per_row(rows: DataFrame, docs: DataFrame, changed: DataFrame, text: str, length: int, kept: str, nothing) -> DataFrame:
    """Rows (``id, key, n_bytes, <kept>``) with what their text lost; untouched ones keep ``<kept>``."""
    whole = _copied(docs, text, length).withColumn("whole", F.lit(True))
    after = changed.withColumnRenamed(kept, "after")
    joined = rows.join(after, "key", "left").join(whole, "key", "left")
    copied = F.col("whole").isNotNull()
    none = F.lit(0).cast("bigint")
    return joined.select(
        "id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(copied, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(copied, nothing).otherwise(F.coalesce("after", kept)).alias(kept),
    )


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 200, crowd: int = CROWD) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every row."""
    texts = distinct_texts(docs, text)
    changed = _without(texts, repeated_ranges(texts, length, crowd), length)
    body = text_of(text)
    rows = docs.select(F.col(f"`{id}`").alias("id"), text_key(body).alias("key"), utf8_length(body).alias("n_bytes"), body.cast("binary").alias("kept"))
    return _per_row(rows, docs, changed, text, length, "kept", F.lit("").cast("binary")).withColumnRenamed("id", id)


def repeat_figures(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 200, crowd: int = CROWD) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of every row: no row's bytes move to it."""
    texts = distinct_texts(docs, text)
    changed = _without(texts, repeated_ranges(texts, length, crowd), length)
    digests = changed.select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    body = text_of(text)
    rows = docs.select(
        F.col(f"`{id}`").alias("id"), text_key(body).alias("key"), utf8_length(body).alias("n_bytes"), F.sha2(body, 256).alias("kept_sha256")
    )
    nothing = F.sha2(F.lit(""), 256)
    return _per_row(rows, docs, digests, text, length, "kept_sha256", nothing).withColumnRenamed("id", id)
