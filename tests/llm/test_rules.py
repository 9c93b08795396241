"""Quality rules: base figures and certificates against plain Python, and the promised risk on fresh labels."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from tests.llm.texts import documents, frame
from waymesh.llm import rules


def brute(text):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search("[^ \t-\r]", line)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


ODD = ["a a a a", "a b c x a b c", "a b a b a b", "one\ntwo\none\n \n \none ", "x\r\nx\r\n", "\x0b\x0c\t ", "# * $%&|<> 😀é漢 \x1f\x00 \x85\xa0", "a b c d " * 40]


def test_base_figures(spark):
    rows = documents(4) + [(900 + i, t, "en", "k", 7, True, 3, "b", "r") for i, t in enumerate(ODD)]
    got = rules.measured(frame(spark, rows)).drop("stratum").collect()
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(((r.id, *[r[f] for f in figures]) for r in got), key=repr) == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)


@pytest.mark.parametrize(("n", "k", "share"), [(0, 0, 0.1), (10, 0, 0.3), (200, 7, 0.05), (5000, 12, 0.0033), (50, 40, 0.1)])
def test_binomial_sum(spark, n, k, share):
    p = Fraction(share)
    exact = float(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))
    got = spark.range(1).select(rules.binomial_at_most(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), share).alias("p")).first().p
    assert got == (1.0 if k > n * share else pytest.approx(exact, rel=1e-9))


def holdout(rng, good, bad, lang):
    """Badness of labelled documents of one language as counts: good ones rarely exceed a cutoff."""
    rows = Counter()
    for quality, n, mean in ((1, good, 2.0), (0, bad, 30.0)):
        for _ in range(n):
            rows[lang, "symbols", min(rules.GRID, int(rng.expovariate(1 / mean))), quality] += 1
    return [(lang, rule, above, n if q else 0, 0 if q else n) for (lang, rule, above, q), n in rows.items()]


def test_certified_cutoff_keeps_its_promise(spark):
    share, broken, used = rules.FALSE_REJECTION / len(rules.RULES), 0, 0
    rows = [r for k in range(40) for r in holdout(random.Random(k), 6000, 500, f"l{k}")]
    counts = spark.createDataFrame(rows, "stratum string, rule string, above int, good long, bad long")
    for row in rules.certified_cutoffs(counts).collect():
        used += 1
        # a good document exceeds the cutoff if its badness is drawn above it
        broken += 2.718281828 ** (-(row.cutoff + 1) / 2.0) > share
        assert row.lost <= share * row.n_good and row.caught > rules.GOOD_WEIGHT * row.lost
        k, n, p = row.lost, row.n_good, Fraction(share)
        tail = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert float(tail) <= rules.ERROR / (40 * len(rules.RULES)) and row.p_value == pytest.approx(float(tail), rel=1e-6)
    assert used == 40 and broken == 0


def test_too_few_labels_keep_everything(spark):
    rows = holdout(random.Random(1), 300, 300, "en")
    assert rules.certified_cutoffs(spark.createDataFrame(rows, "stratum string, rule string, above int, good long, bad long")).count() == 0


def labelled(spark, many):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    docs, labels = [], []
    for i in range(many):
        good = i % 4 != 0
        text = " ".join(rng.choice(words) + ("" if good else " ##") for _ in range(60))
        docs.append((i, text, "en" if i % 8 < 6 else None, "k", 7, True, 3, "b", "r"))
        if i % 2 == 0 or good:
            labels.append((i, int(good), 0))
    docs += [(None, "x " * 70, "en", "k", 7, True, 3, "b", "r"), (3, None, "en", "k", 7, True, 3, "b", "r"), (3, "", None, "k", 7, True, 3, "b", "r")]
    labels += [(1, None, 0), (2, 0, 0), (2, 1, 0), (10**9, 1, 0), (None, 1, 0)]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_verdicts(spark):
    docs, labels, rows = labelled(spark, 2400)
    got = rules.judge_documents(docs, labels, false_rejection=0.05)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.failed_rules == "")
    bad = [r for r in found if r.doc_id is not None and r.doc_id % 4 == 0 and r.n_words]
    good = [r for r in found if r.doc_id is not None and r.doc_id % 4 != 0 and r.n_words]
    assert not any(r.kept for r in bad if r.doc_id % 8 < 6) and all(r.kept for r in good)


def test_without_labels_or_documents(spark):
    docs, labels, _ = labelled(spark, 40)
    kept = rules.judge_documents(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in kept)
    assert rules.judge_documents(docs.limit(0), labels).count() == 0


def test_no_python_in_the_plan(spark):
    docs, labels, _ = labelled(spark, 40)
    plan = rules.judge_documents(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
