"""The path cache: lookups, misses, reads of either spelling and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.text import parse_id_list


def read_paths(docs: DataFrame) -> DataFrame:
    """Normalise cached paths to ``node1, node2, path array<bigint>``.

    Documents may name the ends ``x, y`` or ``node1, node2`` and hold the path as
    an array (``path``) or as the text of a list (``path_text``, or a string ``path``).
    """
    names = set(docs.columns)
    pick = lambda *options: F.coalesce(*[F.col(o).try_cast("bigint") for o in options if o in names])
    candidates = []
    for column in ("path", "path_text"):
        if column in names:
            text = dict(docs.dtypes)[column] == "string"
            candidates.append(parse_id_list(column) if text else F.col(column).cast("array<bigint>"))
    return docs.select(
        pick("node1", "x").alias("node1"), pick("node2", "y").alias("node2"), F.coalesce(*candidates).alias("path")
    )


def one_per_pair(cache: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """One entry per pair: the cheapest path, then the smallest other columns.

    With ``asked`` (``node1, node2``) only the pairs asked for are looked at: a batch
    never groups the whole cache.
    """
    if asked is not None:
        cache = cache.join(asked.select("node1", "node2").distinct(), ["node1", "node2"], "left_semi")
    rest = [c for c in cache.columns if c not in ("node1", "node2")]
    first = [c for c in ("cost_c", "hops") if c in rest]
    rank = first + [c for c in rest if c not in first]
    best = cache.groupBy("node1", "node2").agg(F.min(F.struct(*rank)).alias("best"))
    return best.select("node1", "node2", "best.*")


def cache_hits(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Requested pairs with their cached path."""
    return pairs.join(one_per_pair(cache, pairs), ["node1", "node2"])


def cache_misses(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Requested pairs the cache lacks, each once: repeats combine before the shuffle."""
    return pairs.select("node1", "node2").distinct().join(
        cache.select("node1", "node2"), ["node1", "node2"], "left_anti"
    )


def cache_stats(paths: DataFrame) -> DataFrame:
    """Entries and different pairs of a cache, in two combining steps."""
    return (
        paths.groupBy("node1", "node2").agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("entries"),
            F.count(F.lit(1)).alias("pairs"),
            F.coalesce(F.max("n"), F.lit(0).cast("bigint")).alias("most_repeated"),
        )
    )
