import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.texts import documents, frame
from waymesh.llm import exact, sharding


def test_groups_against_plain_python(spark):
    rows = documents()
    by_text = defaultdict(list)
    for r in rows:
        by_text[r[1] or ""].append(r[0])
    largest = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in by_text.items()}
    want = sorted(
        (str(r[0]), str(largest[r[1] or ""]), len(by_text[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows
    )
    got = exact.exact_groups(frame(spark), carry={"text_sha256": F.sha2("body", 256)}).collect()
    assert sorted((str(g.doc_id), str(g.keep_id), g.group_size, g.text_sha256) for g in got) == want
    kept = [g for g in got if g.kept]
    assert len(kept) == len(by_text) and all(g.doc_id == g.keep_id for g in kept)


def test_equal_beginnings_and_lengths_are_told_apart(spark):
    rows = [(1, "a" * 100 + "b"), (2, "a" * 100 + "c"), (3, "a" * 100 + "b"), (4, "b" + "a" * 100)]
    got = {g.doc_id: (g.keep_id, g.kept) for g in exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, False), 2: (2, True), 3: (3, True), 4: (4, True)}


def test_one_row_of_every_text_stays(spark):
    left = exact.drop_copies(frame(spark))
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in documents()})
    assert left.columns == frame(spark).columns
    assert {r.doc_id for r in left.filter("text = ''").collect()} | {r.doc_id for r in left.filter("text is null").collect()} == {203}


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact.exact_groups(empty).count() == 0 == exact.drop_copies(empty).count()
    assert sharding.shard_documents(empty).count() == 0


def jump(key, shards):
    """The published algorithm."""
    key, b, j = (key or 0) % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_follow_the_published_algorithm(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(2, 200), *(k * 7919**3 for k in range(1, 200))]
    frame_ = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for shards in (1, 2, 16, 17, 100):
        got = sharding.with_shard(frame_, shards).collect()
        assert all(r.shard == jump(r.doc_id, shards) for r in got)


def test_slots_have_no_gaps_and_new_shard_takes_rows_only_into_itself(spark):
    got = sharding.shard_documents(frame(spark), 4).collect()
    rows = documents()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), jump(r[0], 4), jump(r[0], 5)) for r in rows)
    assert sorted((str(g.doc_id), g.size, g.text_crc32, g.shard, g.grown_shard) for g in got) == want
    slots = defaultdict(list)
    for g in got:
        assert g.law == "key" and (g.grown_shard == g.shard or g.grown_shard == 4)
        slots[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_over_many_chunks_and_a_hot_row(spark):
    rows = spark.range(500).select((F.col("id") % 60).alias("doc_id")).unionByName(spark.range(300).select(F.lit(7).cast("long").alias("doc_id")))
    got = sharding.number_in_shards(sharding.with_shard(rows, 5), ["doc_id"], chunk_rows=10).collect()
    slots = defaultdict(list)
    for g in got:
        slots[g.shard].append(g.slot)
    assert len(got) == 800 and all(sorted(s) == list(range(len(s))) for s in slots.values())
