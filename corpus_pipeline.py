"""Corpus preparation in stages, each written as Parquet and read again as the next one's documents.

Every stage works on all rows its predecessor kept. Defined results: nulls, empty and repeated rows and
empty tables are handled as the operators say; the other columns of ``documents`` pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymesh.llm import bpe, decontaminate, exact, jaccard, quality
from waymesh.llm.common import table
from waymesh.runtime import checkpoint_root

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every text stays, the one with the largest doc_id."""
    return exact.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of similar texts stays, the one with the smallest doc_id."""
    return jaccard.one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"), per_text=True)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The figures of every document's token ids and of what they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_documents),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("bpe_codec", token_ids),
]

#: A trained model and the vocabulary's merges are beyond SQL; a plain Python version in the tests takes its place.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of every stage are written to the shared folder."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
