import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.texts import SCHEMA, documents, frame, prose
from waymesh.llm import decontaminate
from waymesh.llm.queries import all_queries

WORD = re.compile(r"[^\W_]+")


def shingles(text, n=5):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def tables(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, 8 + 9 * k)) for k in range(12)] + [(50, "too short"), (51, None), (None, prose(rng, 30)), (3, prose(rng, 20))]
    rows = documents()
    for k, (item, text) in enumerate(items):
        if text:
            rows.append((300 + k, prose(rng, 300) + ". " + text.upper() + "! " + prose(rng, 200), *rows[0][2:]))
            words = text.split()
            words[len(words) // 2] = "other"
            rows.append((400 + k, prose(rng, 40) + " " + " ".join(words), *rows[0][2:]))
    rows.append(rows[-2])
    return rows, items, frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as key", "2 as u")


def brute(rows, items):
    sets = {}
    for item, text in items:
        if shingles(text):
            sets[item] = sets.get(item, set()) | shingles(text)
    found = Counter()
    for r in rows:
        there = shingles(r[1])
        for item, s in sets.items():
            if len(s & there) >= 0.8 * len(s):
                found[r[0], item, len(s), len(s & there)] += 1
    return found


def test_against_all_pairs(spark):
    rows, items, docs, bench = tables(spark)
    got = decontaminate.contaminated(docs, bench).collect()
    assert Counter((g.doc_id, g.item_id, g.item_size, g.shared) for g in got) == brute(rows, items)


def test_clean_rows_stay(spark):
    rows, items, docs, bench = tables(spark)
    bad = {k[0] for k in brute(rows, items)}
    left = decontaminate.without_items(docs, bench)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(r[0] for r in rows if r[0] not in bad)


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    rng = random.Random(12)
    texts = [prose(rng, 40 + k) for k in range(5)]
    items = [(0, texts[0]), (0, texts[1]), (0, texts[1].upper()), (None, texts[2]), (None, texts[3]), (1, texts[4]), (2, texts[4])]
    first = documents()[0][2:]
    rows = [(k, prose(rng, 100) + ". " + t + ". " + prose(rng, 50), *first) for k, t in enumerate(texts)] + [(9, prose(rng, 90), *first)]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for item, s in {(item, frozenset(shingles(text))) for item, text in items}:
        for r in rows:
            if (shared := len(s & shingles(r[1]))) >= 0.8 * len(s):
                want[r[0], item, len(s), shared] += 1
    assert len(want) == 6
    got = decontaminate.contaminated(docs, bench, per_text=True).collect()
    assert Counter((g.doc_id, g.item_id, g.item_size, g.shared) for g in got) == want
    assert [r.doc_id for r in decontaminate.without_items(docs, bench, per_text=True).collect()] == [9]


def test_the_queries_judge_texts_one_by_one(spark, tmp_path):
    rng = random.Random(13)
    texts = [prose(rng, 40), prose(rng, 45)]
    frame(spark, [(k, t, *documents()[0][2:]) for k, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, t) for t in texts], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in all_queries()["op9_decontaminate"](spark, str(tmp_path)).collect()) == [0, 1]


def test_bins_reach_the_recall():
    rng = random.Random(1)
    for u in (8, 32):
        bins, missed = decontaminate.bins_for(u, 0.8, 0.99), 0

        def minima(hashes, bins=bins):
            least = {}
            for h in hashes:
                least[h % bins] = min(h, least.get(h % bins, h))
            return set(least.values())

        for _ in range(1000):
            item = [rng.getrandbits(60) for _ in range(u // 2 + 1)]
            part = item[:-(-4 * len(item) // 5)]
            missed += not minima(item) & minima(part + [rng.getrandbits(60) for _ in range(2 * u - len(part))])
        assert missed <= 20


def test_empty_tables(spark):
    _, _, docs, bench = tables(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.without_items(docs, none).count() == docs.count()
    assert spark.createDataFrame([], SCHEMA).columns == decontaminate.without_items(frame(spark, []), none).columns


def test_texts_without_a_shingle_of_an_item_are_not_sketched(spark, monkeypatch):
    whole = decontaminate.block_minima

    def guarded(shingles, u, bins):
        sketched = F.raise_error(F.lit("a clean text is sketched")).cast("array<bigint>")
        return F.when(F.size(shingles) <= 100, whole(shingles, u, bins)).otherwise(sketched)

    monkeypatch.setattr(decontaminate, "block_minima", guarded)
    item = " ".join(f"item{k}" for k in range(20))
    docs = [(1, " ".join(f"clean{k}" for k in range(500))), (2, f"before it {item} behind it"), (3, None), (None, f"before it {item} behind it")]
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"), per_text=True
    )
    assert sorted((r.doc_id or 0, r.item_id, r.shared) for r in found.collect()) == [(0, 7, 16), (2, 7, 16)]
