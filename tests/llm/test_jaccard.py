from collections import Counter

import numpy as np
import pytest

from tests.llm.texts import documents, frame
from waymesh.llm import jaccard


def brute(rows, threshold=0.8, n=5):
    """Class and links of every row, by comparing all pairs."""
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else None)
    words = [" ".join((r[1] or "").lower().split()) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = words[i] == words[j] or a and b and len(a & b) >= threshold * len(a | b)
            if same:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(root(i), []).append(r[0])
    best = {k: min((v for v in ids_ if v is not None), default=None) for k, ids_ in ids.items()}
    return [(r[0], best[root(i)], links[i]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [128, 2])
def test_classes_and_links_against_all_pairs(spark, block):
    got = jaccard.similar_texts(frame(spark), block=block).collect()
    assert Counter((g.doc_id, g.class_id, g.n_links) for g in got) == Counter(brute(documents()))


def test_one_of_each_class_stays(spark):
    left = jaccard.one_per_class(frame(spark))
    want = brute(documents())
    classes = {c for _, c, _ in want}
    assert left.columns == frame(spark).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(c) for c in classes)


def test_repeated_rows_leave_one(spark):
    row = documents()[0]
    assert jaccard.one_per_class(frame(spark, [row, row, row])).collect() == frame(spark, [row]).collect()


def test_bands_reach_the_recall():
    for rows in (3, 5, 8):
        bands = jaccard.bands_for(0.8, 0.999, rows)
        assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_intersections_of_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, 6000)).astype(np.uint64) for _ in range(7)]
    got = jaccard.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(7) for j in range(7) if i != j)


def test_empty_table(spark):
    assert jaccard.similar_texts(frame(spark, [])).count() == 0 == jaccard.one_per_class(frame(spark, [])).count()
