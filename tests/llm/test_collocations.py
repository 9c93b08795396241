"""Collocations against counting every phrase of every piece in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymesh.llm import collocations as co

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, report=2000):
    counts, totals = defaultdict(Counter), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, n in totals.items():
        f = counts[lang]
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {
            q[i:i + k] for q, b in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 80 * f[q[i:i + k]]
        }
        scored = []
        for p, a in found.items():
            if p not in dropped:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:report], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts(seed=3, count=120):
    rng = random.Random(seed)
    words = "the of and a river Stone market seven light papér 漢字 x#1".split()
    passage = " ".join(f"word{k}" for k in range(40))
    rows = []
    for i in range(count):
        text = ""
        for _ in range(rng.randrange(1, 12)):
            piece = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))
            text += piece + rng.choice([". ", ",", "\n", "\r\n", "!? ", "\x0b", ";\t"])
        if i % 4 == 0:
            text += passage + rng.choice([".", " the", ""])
        rows.append((rng.choice(["en", "de", None]), text))
    return rows + [("en", None), ("en", ""), ("xx", " \t "), ("xx", "...,,"), ("de", "one\x00two A\xa0b " * 50), ("fr", "go " * 3000)]


def frame(spark, rows):
    data = [(i, text, lang, "k", 1, "p") for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, gram string, n int, phrase string")


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("cells", [1 << 16, 64])
def test_equal_to_brute_force_with_many_cells_and_few(spark, cells):
    rows = texts()
    want = brute(rows, 12)
    assert want and got(co.collocations(frame(spark, rows).repartition(5), least=12, cells=cells)) == want


def test_small_slices_small_fan_in_and_short_paths(spark, monkeypatch):
    rows = texts(5)
    monkeypatch.setattr(co, "FAN_IN", 2)
    parts = co.graph_parts(frame(spark, rows).repartition(7).select(F.coalesce("text", F.lit("")).alias("body"), F.coalesce("lang", F.lit("und")).alias("lang")), 12, 1024)
    edges = parts.filter("size = 4 AND n >= 12").select("lang", "gram", "n")
    want = {(r.lang, r.gram): r.n for r in edges.collect()}
    for longest in (4096, 3):
        seen = {}
        for row in co.compacted_paths(edges, longest).collect():
            assert len(row.words) == len(row.weights) + 3 and len(row.weights) <= longest
            for k, n in enumerate(row.weights):
                assert (row.lang, " ".join(row.words[k:k + 4])) not in seen
                seen[row.lang, " ".join(row.words[k:k + 4])] = n
        assert seen == want
    whole = max(len(r.weights) for r in co.compacted_paths(edges).collect())
    assert whole >= 30  # the shared passage is one path


def test_report_is_cut_per_language_and_counts_repeat_rows(spark):
    rows = texts(7, 60) * 2
    assert got(co.collocations(frame(spark, rows), least=10, report=3, cells=1 << 16)) == brute(rows, 10, 3)


def test_empty_and_nothing_frequent(spark):
    assert got(co.collocations(frame(spark, [("en", "a b c")]).limit(0), cells=1 << 16)) == []
    assert got(co.collocations(frame(spark, [("en", "a b c d e")]), cells=1 << 16)) == []


def test_words_of_a_slice():
    words = co.Words(pa.array(["Ab c.d", "", "e  F\x00", "\n"]), pa.array(["x", "x", "y", "y"]))
    names = words.names.to_pylist()
    assert [names[i] for i in words.ids] == ["ab", "c", "d", "e", "f\x00"]
    assert list(words.joined()) == [True, False, False, True]


def test_large_counts_do_not_overflow(spark):
    big = 4_000_000_000_000_000
    score = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long").select(
        F.expr("(2000000 * CAST(a AS DECIMAL(28, 0))) div (CAST(l AS DECIMAL(28, 0)) + r)").cast("bigint").alias("s")
    ).first().s
    assert score == 2_000_000 * big // (2 * big + 1)
