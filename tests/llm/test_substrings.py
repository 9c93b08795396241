import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.llm.texts import documents, frame
from waymesh.llm import substrings
from waymesh.llm.common import map_in_parts, slices


def brute(texts, length):
    """Bytes, removed bytes, runs and the rest, by counting all windows."""
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("length", "crowd"), [(200, 20_000), (60, 1)])
def test_against_counting_all_windows(spark, length, crowd):
    rows = documents()
    want = Counter((r[0], *b) for r, b in zip(rows, brute([(r[1] or "").encode() for r in rows], length), strict=True))
    got = substrings.remove_repeats(frame(spark), length=length, crowd=crowd).collect()
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, bytes(g.kept)) for g in got) == want
    figures = substrings.repeat_figures(frame(spark), length=length, crowd=crowd).collect()
    digests = Counter()
    for (own, size, removed, spans, kept), n in want.items():
        digests[own, size, removed, spans, hashlib.sha256(kept).hexdigest()] += n
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in figures) == digests


def test_suffixes_are_sorted_to_the_depth():
    rng = random.Random(2)
    for _ in range(60):
        depth, letters = rng.choice([10, 40, 64, 100]), rng.choice(["ab", "a", "abcdefgh"])
        base = "".join(rng.choice(letters) for _ in range(150))
        texts = []
        for _ in range(9):
            t = list(base)
            t[rng.randrange(150)] = rng.choice(letters + "z")
            texts.append("".join(t).encode())
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.concatenate([150 * k + np.arange(150 - depth + 1) for k in range(9)])
        group = np.repeat([rng.randrange(2) for _ in range(9)], 150 - depth + 1)
        order, classes = substrings.sort_suffixes(data, starts, group, depth)
        raw = data.tobytes()
        keys = [(group[i], raw[starts[i]:starts[i] + depth]) for i in order]
        assert keys == sorted(keys)
        assert all((classes[i] == classes[i + 1]) == (keys[i] == keys[i + 1]) for i in range(len(keys) - 1))


def test_equal_windows_have_equal_anchors(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(substrings, "_CHUNK", 100)
    for _ in range(60):
        length, letters = rng.choice([20, 60, 200]), rng.choice(["ab", "a", "abcdefgh"])
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(500))).encode() for _ in range(5)]
        seen: dict[bytes, int] = {}
        for found in (substrings.anchors(texts, length), [substrings.text_anchors(t, length) for t in texts]):
            for t, (h, first, last) in zip(texts, found, strict=True):
                starts = []
                for x, a, b in zip(h, first, last, strict=True):
                    starts += range(a, b + 1)
                    assert all(seen.setdefault(t[i:i + length], x) == x for i in range(a, b + 1))
                assert starts == list(range(len(t) - length + 1))


def test_a_long_row_comes_alone():
    texts = pd.Series(["é" * 17, "a" * 2, "a" * 2, "a" * 3, "", "b" * 9])
    parts = [p["body"].tolist() for p in slices(pd.DataFrame({"body": texts}), texts, most=4)]
    assert parts == [[texts[0]], ["aa", "aa"], ["aaa", ""], ["b" * 9]]
    octets = pd.Series(["éé", "éé", "a"])
    assert [len(p) for p in slices(pd.DataFrame({"body": octets}), octets, most=5)] == [1, 2]


def test_anchors_of_more_bytes_than_places(monkeypatch):
    monkeypatch.setattr(substrings, "_PLACE", np.uint64(0xFFF))
    rng = random.Random(4)
    passage = bytes(rng.randrange(256) for _ in range(400))
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    # the passage stands behind place 4,096: in the tail of a long text and in the short ones behind it
    texts = [passage + noise(9_000) + passage, noise(100) + passage, passage + noise(50), b"", noise(10)]
    seen: dict[bytes, int] = {}
    for t, (h, first, last) in zip(texts, substrings.anchors(texts, 200), strict=True):
        starts = []
        for x, a, b in zip(h, first, last, strict=True):
            starts += range(a, b + 1)
            assert all(seen.setdefault(t[i:i + 200], x) == x for i in range(a, b + 1))
        assert starts == list(range(len(t) - 199))


def test_a_crowded_anchor_is_never_gathered(spark, monkeypatch):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line, passage = noise(70), noise(130)
    texts = [noise(90) + line + noise(90) for _ in range(40)] + [noise(80) + passage + noise(60) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    largest, sort = [], substrings._sorted_marks

    def watched(contexts, by, length):
        largest.append(max((r["count"] for r in contexts.groupBy(*by).count().collect()), default=0))
        return sort(contexts, by, length)

    monkeypatch.setattr(substrings, "_sorted_marks", watched)
    got = substrings.remove_repeats(docs, length=100, crowd=8).orderBy("doc_id").collect()
    want = brute([t.encode() for t in texts], 100)
    assert [(g.n_bytes, g.n_removed, g.n_spans, bytes(g.kept)) for g in got] == want
    assert sum(w[1] for w in want) >= 30 * 130
    assert max(largest) <= 8


def test_periodic_texts_and_few_cells(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(substrings, "_WINDOWS", 50)
    monkeypatch.setattr(substrings, "_RUNS", 30)
    monkeypatch.setattr(substrings, "_CONTEXT_BYTES", 500)
    monkeypatch.setattr(substrings, "CELLS", 64)  # nearly all cells are taken: more is moved, nothing else changes
    line = "".join(rng.choice("abcdefgh ") for _ in range(37))
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    texts = ["a" * 700, line * 20, noise(80) + line * 3 + noise(80), noise(60) + "a" * 130 + "b", noise(150), "", noise(30) + line * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substrings.remove_repeats(docs, length=100).orderBy("doc_id").collect()
    assert [(g.n_bytes, g.n_removed, g.n_spans, bytes(g.kept)) for g in got] == brute([t.encode() for t in texts], 100)


def test_empty_table(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_copies_are_folded_once(spark):
    texts = substrings.distinct_texts(frame(spark))
    bodies = [r.body for r in texts.collect()]
    assert Counter(bodies) == Counter({r[1] or "" for r in documents()})
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "Aggregate" not in plan


def test_frames_hold_few_bytes_of_text(spark):
    rows = spark.range(50).selectExpr("id", "repeat('é', cast(id as int)) as body", "array(named_struct('a', id, 'b', id + 1)) as runs")

    def work(frames):
        for f in frames:
            size = sum(len(b.encode()) for b in f["body"])
            yield pd.DataFrame({"id": f["id"], "own": [len(f)] * len(f), "size": [size] * len(f), "runs": [list(r) for r in f["runs"]]})

    got = map_in_parts(rows, work, "id bigint, own bigint, size bigint, runs array<struct<a:bigint,b:bigint>>", 200).collect()
    assert sorted(g.id for g in got) == list(range(50)) and all(g.runs[0].b == g.id + 1 for g in got)
    assert all(g.size < 400 or g.own == 1 for g in got)
