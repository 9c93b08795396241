"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.llm import (
    bpe, chat, collocations, decontaminate, exact, jaccard, pii, quality, rules, sharding, substrings, trie, urls,
)
from waymesh.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


@_query
def op1_semi_markov_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: spans of the fixed patterns and those the model adds."""
    found = pii.find_personal_data(table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@_query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that stand anywhere else too."""
    return substrings.repeat_figures(table(spark, folder, "documents"), length=200)


@_query
def op3_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as ids of the public many-language vocabulary, and decoded again."""
    import public_tokenizers

    return bpe.digests(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


@_query
def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's class of similar texts (words by fives, similarity 0.8) and its number of links."""
    return jaccard.similar_texts(table(spark, folder, "documents")).drop("class_key")


@_query
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    return exact.exact_groups(
        table(spark, folder, "documents"), carry={"text_sha256": F.sha2(F.col("body"), 256)}
    )


@_query
def op6_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation once per participant, with that one as the assistant."""
    return chat.perspectives(table(spark, folder, "conversations"))


@_query
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path and verdict of every page's url."""
    return urls.judge_urls(table(spark, folder, "pages"))


@_query
def op8_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards, and where they go with 17."""
    return sharding.shard_documents(table(spark, folder, "documents"), 16)


@_query
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that contain benchmark items, and which."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), per_text=True)


@_query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document."""
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All distinct beginnings of the rebuilt conversations as a tree, with members and sums over subtrees."""
    return trie.conversation_trie(table(spark, folder, "conversations"))


@_query
def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The figures of every document's words and lines, and whether the rules keep it."""
    return rules.judge_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest phrases of two to four words of every language."""
    return collocations.collocations(table(spark, folder, "documents"))
