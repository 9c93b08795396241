"""Byte-level BPE: DuckDB recursive queries merge and decode inside every partition.

Encoding. A text is cut by the vocabulary's pattern; each piece that is no token itself is
spread over rows (word, position, token), one per byte. The recursive query joins
neighbouring rows with the merge table and contracts, per word and round, the leftmost
pair of minimum rank, until no pair of any word can be merged. Two kinds of pairs are
contracted in the same round, because one merge at a time would contract them before anything
next to them changes:

* all pairs of the minimum rank, from the left without overlap, if no pair that the new token could form has a lower rank;
* a pair of any rank whose neighbours can only be merged later. The merge table holds, for two tokens side by side, the
  lowest rank of a token that could ever be made across the place between them while the left or the right one is whole.

So the rounds depend little on the length of a word, and the result is that of one merge at a time.

Decoding joins (document, position, id) rows with the vocabulary and puts the bytes
together with an ordered aggregation.

A partition is worked on in batches of bounded size, nothing is shuffled, and pieces seen
before come from a bounded memory of the process. A lost executor repeats its partitions.

Defined results: a null text is an empty one; it has no ids and decodes to nothing. Equal rows
are encoded alike. Special tokens are ordinary text. Other columns play no part.
"""

from __future__ import annotations

import base64
import ctypes
import gc
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import arrow_parts, text_of
from waymesh.runtime import ship

#: Pieces whose ids a process remembers, and the bytes of the longest piece that is remembered.
MEMORY_PIECES, MEMORY_BYTES = 250_000, 64
#: Bytes of text that are cut into pieces at a time (a single longer text goes alone).
SLICE_BYTES = 700_000
#: Bytes of new pieces that one recursive query works on (a single longer piece goes alone).
QUERY_BYTES = 125_000
#: Memory of a query; one on a single longer piece or document may take `LONG_BYTES` more per byte beyond the usual.
QUERY_MB, LONG_BYTES = 300, 1_000
#: Tokens that one decoding query works on (a single longer document goes alone).
QUERY_TOKENS = 100_000

# ``pair`` is a token and the one behind it, ``rank`` that of the token they make, ``best`` the minimum rank of a
# word's pairs with the leftmost position of it in its lower half; ``nth`` counts from the last row that is no hit, so
# odd ones can be contracted and even ones vanish. ``from_left`` and ``from_right`` are the lowest ranks at which the
# place between the two tokens can still vanish while its right or left token stays as it is (``never``: at no rank);
# the last row of a word has no pair, so ``lag`` sees a closed place before the first row of the next word.
_STEP = """
    (with met as materialized (
        select w.word, w.pos, w.token, w.opens, m.merged, coalesce(m.from_left, {never}) as from_left, coalesce(m.from_right, {never}) as from_right
        from {rows} w left join pairs m on m.pair = w.pair
    )
    select met.*, least.best
    from met left join (select word, min(merged::bigint << 32 | pos) as best from met where merged is not null group by word) least on least.word = met.word)
"""
_NEVER = 2147483647
_REACH = 4  # places looked at on either side of a pair


def _shut(side: str, above: str) -> str:
    """Whether nothing from one side can reach a pair before its own rank is due: a closed place, and only later pairs up to it."""
    found = "false"
    for k in range(_REACH, 0, -1):
        found = f"({side}_{k} {above} rank or rank_{side}_{k} {above} rank and {found})"
    return found


_AROUND = ", ".join(
    f"{move}(from_{side}, {k}, {_NEVER}) over places as {side}_{k}, {move}(coalesce(rank, {_NEVER}), {k}, {_NEVER}) over places as rank_{side}_{k}"
    for move, side in (("lag", "left"), ("lead", "right")) for k in range(1, _REACH + 1)
)
_ENCODE = f"""
with recursive work(word, pos, token, opens, rank, from_left, from_right, best) as (
    {_STEP.format(never=_NEVER, rows="""(
        select word, pos, token, lag(word) over (order by pos) is distinct from word as opens,
               case when lead(word) over (order by pos) = word then token::bigint * 65536 + lead(token) over (order by pos) end as pair
        from start
    )""")}
  union all
    {_STEP.format(never=_NEVER, rows="""(
        select * from (
            select word, opens, token, coalesce(lag(hit) over (order by pos), false) as gone,
                   (row_number() over (order by pos) - sum(hit::integer) over (order by pos) + hit::integer)::integer as pos,
                   case when hit then case when lead(word, 2) over (order by pos) = word then token::bigint * 65536 + lead(token, 2) over (order by pos) end
                        when lead(word) over (order by pos) = word then token::bigint * 65536 + lead(token) over (order by pos) end as pair
            from (
                select word, pos, opens, hit, case when hit then rank else token end as token
                from (
                    select word, pos, opens, token, rank, rank is not null and (
                        case when rank > best >> 32 then false when alone then pos = best & 4294967295
                             when opens then true else (pos - after) % 2 = 1 end
                        or {shut_left} and {shut_right}
                    ) as hit
                    from (
                        select work.*, u.token is not null as alone,
                               max(case when rank is distinct from best >> 32 then pos when opens then pos - 1 end) over before as after,
                               {around}
                        from work left join stepwise u on u.token = best >> 32 where best is not null
                        window places as (order by pos), before as (order by pos rows between unbounded preceding and 1 preceding)
                    )
                )
            )
        ) where not gone
    )""".replace("{shut_left}", _shut("left", ">")).replace("{shut_right}", _shut("right", ">=")).replace("{around}", _AROUND))}
)
select word, list(token order by pos) as ids from work where best is null group by word
"""

_DECODE = "select doc, list(v.token order by pos) as parts from ids join vocab v on v.id = ids.id group by doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: per line a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes pieces and decodes ids with one in-memory DuckDB connection."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        if max(self.ranks.values(), default=0) >= 65536:
            raise ValueError("pairs of ids are packed as two numbers below 65536")
        self.split = regex.compile(pattern).findall
        self.seen: dict[str, bytes] = {}
        self.allowed = QUERY_MB
        # nothing may go to a folder of the machine
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{QUERY_MB}MB", "temp_directory": ""})
        vocab = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "token": pa.array(self.ranks, pa.binary())})  # noqa: F841
        self.db.execute("create table vocab as select id, token from vocab")
        self._pairs()
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)

    def _pairs(self) -> None:
        """All pairs of tokens that are a token together or could become one, and what may happen between them."""
        ranks, joined, parts = self.ranks, array("i"), array("i")
        for token, rank in ranks.items():
            parts.extend((rank, rank, 1, rank, rank, 0))
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    joined.extend((left, right, rank))
                if left is not None:
                    parts.extend((rank, left, 1))
                if right is not None:
                    parts.extend((rank, right, 0))
        a, b, made = np.frombuffer(joined, dtype=np.int32).astype(np.int64).reshape(-1, 3).T
        token, part, front = np.frombuffer(parts, dtype=np.int32).reshape(-1, 3).T

        def with_parts(of: np.ndarray, at_front: int) -> tuple[np.ndarray, np.ndarray]:
            """For each row of ``made`` every part of its token ``of``: the row and the part."""
            own = np.flatnonzero(front == at_front)
            own = own[np.argsort(token[own], kind="stable")]
            first, behind = (np.searchsorted(token[own], of, side) for side in ("left", "right"))
            n = behind - first
            return np.repeat(np.arange(len(of)), n), part[own[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]]

        def lowest(pair: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            by = np.lexsort((rank, pair))
            pair, rank = pair[by], rank[by]
            new = np.r_[True, pair[1:] != pair[:-1]] if len(pair) else np.zeros(0, dtype=bool)
            return pair[new], rank[new].astype(np.int32)

        row, end = with_parts(a, 0)
        left = lowest(end.astype(np.int64) * 65536 + b[row], made[row])
        row, begin = with_parts(b, 1)
        right = lowest(a[row] * 65536 + begin, made[row])
        merged = lowest(a * 65536 + b, made)
        every = np.unique(np.concatenate([left[0], right[0], merged[0]]))
        columns = {"pair": pa.array(every)}
        for name, (pair, rank) in (("merged", merged), ("from_left", left), ("from_right", right)):
            value, missing = np.zeros(len(every), dtype=np.int32), np.ones(len(every), dtype=bool)
            at = np.searchsorted(every, pair)
            value[at], missing[at] = rank, False
            columns[name] = pa.array(value, mask=missing)
        found = pa.table(columns)  # noqa: F841
        self.db.execute("create table pairs as select * from found")
        # tokens that could join a neighbour at a lower rank than their own
        alone = pa.table({"token": pa.array(np.unique(np.concatenate([a[made < a], b[made < b]])))})  # noqa: F841
        self.db.execute("create table stepwise as select * from alone")

    def _allow(self, beyond: int) -> None:
        """Memory for a query that is ``beyond`` bytes larger than the usual ones."""
        wanted = QUERY_MB + max(beyond, 0) * LONG_BYTES // 1_000_000
        if wanted != self.allowed:
            self.db.execute(f"set memory_limit = '{wanted}MB'")
            self.allowed = wanted

    def _merge(self, pieces: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """The ids of some pieces by their numbers: one recursive query."""
        sizes = np.array([len(p) for p in pieces])
        self._allow(int(sizes.sum()) - QUERY_BYTES)
        start = pa.table({  # noqa: F841
            "word": np.repeat(np.arange(len(pieces), dtype=np.int32), sizes),
            "pos": np.arange(sizes.sum(), dtype=np.int32),
            "token": self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)],
        })
        found = self.db.sql(_ENCODE).to_arrow_table()
        ids = found.column("ids").combine_chunks() if found.num_rows else None
        if ids is None:
            return
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        ends = ids.offsets.to_numpy()
        for k, word in enumerate(found.column("word").to_pylist()):
            yield word, flat[ends[k]:ends[k + 1]]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of pieces not seen before."""
        found: dict[str, bytes] = {}
        batch: list[str] = []
        raw: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal batch, raw, size
            if batch:
                for word, ids in self._merge(raw):
                    found[batch[word]] = ids.tobytes()
            batch, raw, size = [], [], 0

        for piece in sorted(pieces):
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                found[piece] = rank.to_bytes(4, "little")
                continue
            if size + len(data) > QUERY_BYTES:
                flush()
            batch.append(piece), raw.append(data)
            size += len(data)
        flush()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, packed."""
        cut = [self.split(t) for t in texts]
        needed: set[str] = set()
        for pieces in cut:
            needed.update(pieces)
        new = self.learn(needed.difference(self.seen))
        room = len(self.seen) < MEMORY_PIECES  # the frequent pieces come early; later ones are rare
        self.seen |= new
        found = [b"".join(map(self.seen.__getitem__, pieces)) for pieces in cut]
        for piece in new:
            if not room or len(piece) > MEMORY_BYTES:
                del self.seen[piece]
        return found

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of every list of ids."""
        out = [b""] * len(packed)
        first, tokens = 0, 0
        for k, data in enumerate(packed):
            tokens += len(data) // 4
            if tokens >= QUERY_TOKENS or k == len(packed) - 1:
                part = packed[first:k + 1]
                self._allow(tokens - QUERY_TOKENS)
                sizes = np.array([len(p) // 4 for p in part])
                ids = pa.table({  # noqa: F841
                    "doc": np.repeat(np.arange(first, k + 1, dtype=np.int32), sizes),
                    "pos": np.arange(sizes.sum(), dtype=np.int32),
                    "id": np.frombuffer(b"".join(part), dtype="<u4").astype(np.int32),
                })
                found = self.db.sql(_DECODE).to_arrow_table().combine_chunks()
                if found.num_rows:
                    parts = found.column("parts").chunk(0)
                    tokens_of = parts.values.cast(pa.large_binary())
                    starts = np.frombuffer(tokens_of.buffers()[1], dtype=np.int64)[tokens_of.offset:]
                    cuts = starts[parts.offsets.to_numpy()].tolist()  # the tokens of a list lie side by side
                    body = tokens_of.buffers()[2]
                    for doc, begin, end in zip(found.column("doc").to_pylist(), cuts[:-1], cuts[1:], strict=True):
                        out[doc] = body[begin:end].to_pybytes()
                first, tokens = k + 1, 0
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The process's codec for a vocabulary: built once, used by all its tasks."""
    key = (path, pattern)
    _give_back()  # what the process's earlier tasks, of other stages, left behind
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern)
        _give_back()  # what building the table of pairs took
    return _codecs[key]


def _give_back() -> None:
    """Return free memory of this process to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def encode_texts(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, ids, decoded`` for every row: the ids as packed bytes and what they decode to."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            for part in arrow_parts(batch, SLICE_BYTES):
                ids = tool.encode(part.column("body").to_pylist())
                columns = [part.column("id"), pa.array(ids, pa.binary()), pa.array(tool.decode(ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"])
                del ids, columns
                pa.default_memory_pool().release_unused()  # what the queries' results took

    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id}`").alias("id"), text_of(text).alias("body"))
    kind = docs.schema[id].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id)


def digests(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: what `encode_texts` gives, as figures."""
    coded = encode_texts(docs, path, pattern, id, text)
    return coded.select(
        F.col(f"`{id}`"), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
