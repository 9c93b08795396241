"""The prefix tree against building it node by node in plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from waymesh.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, digest string, parent string, chunk int, shard int, own int"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), sum(q not in children for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations(seed=2, count=90, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        n = rng.choice([1, 2, 3, 5, 9, longest])
        for t in range(n):
            # a few texts only, so that many conversations share beginnings
            rows.append((c * rng.choice([1, 1, 1, 3]) if t == -1 else c, t, ["user", "assistant"][t % 2], f"text {rng.randrange(2) if t > 2 else 0} é"))
    rows += [(200, 0, "user", "same")] * 3 + [(201, None, None, None), (201, 1, "user", ""), (201, 1, "a", "x"), (None, 0, "user", "lost")]
    rows += [(203, 0, "user", "alone"), (-7, 0, "user", "below zero"), (-5, 0, "user", "text 0 é"), (-5, 1, "assistant", "text 0 é")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", "p", 2, 3, 4) for r in rows], SCHEMA)


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("chunk", "shard_rows", "span"), [(1024, 20_000, 64), (4, 60, 2)])
def test_equal_to_brute_force_in_one_shard_and_many(spark, monkeypatch, chunk, shard_rows, span):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "ENDS_SPAN", span)
    rows = conversations()
    assert got(trie.conversation_trie(frame(spark, rows), shard_rows)) == brute(rows)


def test_equal_conversations_and_long_ones(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = [(c * 5, t, "user", "copy") for c in range(300) for t in range(2)]
    rows += [(c, t, "user", f"{c % 2} {t}") for c in (4000, 4001, 4002) for t in range(100)]
    assert got(trie.conversation_trie(frame(spark, rows), 200)) == brute(rows)


def test_empty(spark):
    assert got(trie.conversation_trie(frame(spark, []))) == []
    assert got(trie.conversation_trie(frame(spark, [(None, 0, "a", "b")]))) == []


def test_table_is_minimal_perfect_and_knows_its_keys():
    rng = np.random.default_rng(1)
    digests = np.array([f"{rng.integers(1 << 62):016x}{k:016x}" for k in range(5000)], dtype=object)
    table = trie.NodeTable(digests)
    assert sorted(table.slots(digests)) == list(range(5000))
    others = np.array([f"{rng.integers(1 << 62):016x}{k:016x}" for k in range(5000, 6000)], dtype=object)
    assert (table.slots(others) == -1).all()
    with pytest.raises(ValueError, match="not distinct"):
        trie.NodeTable(np.array(["0" * 32, "0" * 32], dtype=object))


def test_collision_is_noticed():
    import pandas as pd

    rows = pd.DataFrame({
        "conv_id": [1, 1, 2, 2], "chunk": 0, "depth": [0, 1, 0, 1], "digest": ["0" * 32, "1" * 32] * 2, "parent": [None, "0" * 32] * 2,
        "turn_key": ["", "a", "", "b"], "octets": [0, 1, 0, 1], "top": False, "last": [False, True] * 2, "goes_on": False, "shard": 0,
    })
    with pytest.raises(ValueError, match="same digest"):
        trie._local_nodes((0, 0), rows)
