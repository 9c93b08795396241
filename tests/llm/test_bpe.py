import base64
import hashlib
import random
import struct
import time

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tests.llm.texts import documents, frame
from waymesh.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tool():
    return bpe.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_codec_agrees_with_the_library(tool, encoding):
    rng = random.Random(4)
    texts = [
        "", " ", "a" * 3000, "-" * 2001, "ab" * 500, "é" * 301, "漢字かな" * 40, " \n\t\r\x1c\x00", "<|endoftext|>", "'s 're I'll",
        "".join(rng.choice("abcde ABC12 !?-_\né漢😀") for _ in range(3000)), "".join(rng.choice("etaoin") for _ in range(800)),
    ]
    ids = tool.encode(texts)
    assert ids == [packed(encoding.encode_ordinary(t)) for t in texts]
    assert tool.decode(ids) == [t.encode() for t in texts]


def test_small_memory_changes_nothing(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 5)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 40)
    monkeypatch.setattr(bpe, "QUERY_TOKENS", 7)
    tool = bpe.Codec(PATH, public_tokenizers.PATTERN)
    texts = [r[1] or "" for r in documents()]
    for _ in range(2):
        ids = tool.encode(texts)
        assert ids == [packed(encoding.encode_ordinary(t)) for t in texts]
        assert tool.decode(ids) == [t.encode() for t in texts]


def test_query_figures(spark, encoding):
    want = []
    for r in documents():
        data = packed(encoding.encode_ordinary(r[1] or ""))
        want.append((str(r[0]), len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = bpe.digests(frame(spark), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(g.doc_id), g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got) == sorted(want)
    assert bpe.digests(frame(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_words_take_few_rounds(tool, encoding):
    rng = random.Random(9)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    dashes = "-" * 100_001
    begin = time.process_time()
    ids = tool.encode([word, dashes])
    assert time.process_time() - begin < 60  # one merge of a word at a time would take hours
    assert ids == [packed(encoding.encode_ordinary(word)), packed(encoding.encode_ordinary(dashes))]
    assert tool.decode(ids) == [word.encode(), dashes.encode()]


def test_random_words_of_few_letters(tool, encoding):
    rng = random.Random(10)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for letters in ("ab", "-=", "ést", "ing ", "漢字a") for _ in range(60)]
    assert tool.encode(words) == [packed(encoding.encode_ordinary(w)) for w in words]


def test_memory_left_by_earlier_tasks_is_given_back():
    def resident():
        with open("/proc/self/statm") as lines:
            return int(lines.read().split()[1]) * 4096

    held = [bytes(2_000) for _ in range(100_000)]
    last = bytes(3_000)  # keeps the end of the heap in use
    del held
    before = resident()
    bpe._give_back()
    assert resident() < before - 100_000_000 and len(last) == 3_000


def test_minima_of_words_come_from_groups(tool):
    """No window per word: each round would sort all rows by word once more."""
    start = pa.table({"word": pa.array([0], pa.int32()), "pos": pa.array([0], pa.int32()), "token": pa.array([0], pa.int32())})  # noqa: F841
    plan = tool.db.execute("explain " + bpe._ENCODE).fetchall()[0][1].upper()
    assert "PARTITION BY" not in plan


def test_table_of_pairs(tool):
    """Against the joins in its definition, on a vocabulary of random tokens."""
    rng = random.Random(7)
    words = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(300)}
    own = bpe.Codec.__new__(bpe.Codec)
    own.ranks = {t: k for k, t in enumerate(sorted(words, key=lambda t: (len(t), t)))}
    own.db = tool.db.cursor()
    own.db.execute("create schema small")
    own.db.execute("use small")
    own._pairs()
    made = [(own.ranks[t[:k]], own.ranks[t[k:]], r) for t, r in own.ranks.items() for k in range(1, len(t)) if t[:k] in own.ranks and t[k:] in own.ranks]
    want = {}
    for a, b, r in made:
        left, right = (next(t for t, k in own.ranks.items() if k == x) for x in (a, b))
        for name, pairs in (
            ("merged", [(a, b)]),
            ("left", [(own.ranks[left[k:]], b) for k in range(len(left)) if left[k:] in own.ranks]),
            ("right", [(a, own.ranks[right[:k]]) for k in range(1, len(right) + 1) if right[:k] in own.ranks]),
        ):
            for x, y in pairs:
                at = want.setdefault(x * 65536 + y, {})
                at[name] = min(r, at.get(name, r))
    got = own.db.execute("select pair, merged, from_left, from_right from pairs").fetchall()
    assert {p: tuple(v) for p, *v in got} == {p: (w.get("merged"), w.get("left"), w.get("right")) for p, w in want.items()}
    assert {t for t, in own.db.execute("select token from stepwise").fetchall()} == {t for a, b, r in made for t in (a, b) if r < t}


def test_every_task_gives_back_what_other_stages_left(monkeypatch):
    """A worker that built its codec in an earlier run comes from other stages again."""
    given = []
    monkeypatch.setattr(bpe, "_codecs", {})
    monkeypatch.setattr(bpe, "_give_back", lambda: given.append(len(bpe._codecs)))
    first = bpe.codec(PATH, public_tokenizers.PATTERN)
    begun = len(given)
    assert bpe.codec(PATH, public_tokenizers.PATTERN) is first
    assert len(given) > begun


def test_new_pieces_are_merged_in_small_queries(monkeypatch):
    """600,000 bytes of different words: no query works on more than 125,000 of them."""
    sizes = []
    merge = bpe.Codec._merge
    monkeypatch.setattr(bpe.Codec, "_merge", lambda self, pieces: sizes.append(sum(map(len, pieces))) or merge(self, pieces))
    tool = bpe.Codec(PATH, public_tokenizers.PATTERN)
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfgkmpqvxz") for _ in range(11)) for _ in range(50_000)]
    text = " ".join(words)
    assert tool.decode(tool.encode([text])) == [text.encode()]
    assert len(sizes) > 1 and max(sizes) <= 125_000
