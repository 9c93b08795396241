import base64
import hashlib
import os
import struct
from collections import defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import brute as classes
from waymesh.llm import oracles, quality, queries

SMALL = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality.score_documents(docs, labels).filter("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    largest = defaultdict(int)
    for i, t in rows:
        largest[t] = max(largest[t], i)
    rows = [(i, t) for t, i in largest.items()]
    stays = {c for _, c, _ in classes(rows)}
    rows = [r for r in rows if r[0] in stays]
    bad = {k[0] for k in leaks(rows, items)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        if i not in bad:
            ids = encoding.encode_ordinary(t)
            want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((g.doc_id, g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got) == sorted(want)
    assert len(want) < docs.count()


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SMALL).columns == docs.columns


def test_all_ten_are_registered():
    names = queries.all_queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(oracles.all_oracles()) <= set(names) and os.path.exists(SMALL)
