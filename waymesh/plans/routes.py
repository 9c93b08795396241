"""Pre-computing paths of a sample, and importance from the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.operators.betweenness import betweenness
from waymesh.operators.graph import Box, edges_in_box, sample_pairs, simple_edges
from waymesh.operators.importance import attach_centrality, path_edge_betweenness
from waymesh.operators.shortest import route_pairs
from waymesh.operators.tiles import EDGES_PER_TILE, Tiles, tile_edges
from waymesh.runtime import store
from waymesh.sources.paths import append_paths, open_cache


def precompute_paths(nodes: DataFrame, edges: DataFrame | Tiles, cache_path: str, k: int, seed: str = "0") -> DataFrame:
    """Paths between all ordered pairs of k sampled nodes; new ones are added to the cache."""
    cache = open_cache(nodes.sparkSession, cache_path)
    answers, new = route_pairs(sample_pairs(nodes, k, seed), edges, cache)
    append_paths(new, cache_path)
    return answers


def publish_importance(edges: DataFrame, cache: DataFrame) -> DataFrame:
    """Edges with the share of cached paths that use them."""
    paths = cache.select(F.struct("node1", "node2").alias("path_id"), "path")
    return attach_centrality(edges, path_edge_betweenness(paths))


def window_importance(
    nodes: DataFrame, edges: DataFrame, box: Box, per_tile_edges: int = EDGES_PER_TILE,
) -> tuple[DataFrame, DataFrame]:
    """Exact betweenness of the network inside a map window, written back: ``(edges, nodes)`` with ``centrality``.

    ``edges``: ``u, v, cost_c, way_id`` (stored by place or not), taken both ways. Every piece of a way gets the
    highest value found on the way; nodes and ways on no shortest path get NULL.
    """
    inside = store(edges_in_box(nodes, edges, box)).df
    sub = store(simple_edges(inside.select("u", "v", "cost_c"), directed=False)).df
    both = sub.unionByName(sub.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost_c"))
    by_edge, by_node = betweenness(tile_edges(both, nodes, per_tile_edges), directed=False)
    ways = inside.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "way_id").join(by_edge, ["u", "v"])
    drawn = attach_centrality(inside, ways.select("way_id", F.col("betweenness").alias("centrality")), key="way")
    points = nodes.filter(box.holds()).join(by_node.select(F.col("node").alias("id"), F.col("betweenness").alias("centrality")), "id", "left")
    return drawn, points
