"""Edge importance from given paths, and its publication onto the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.operators.steps import path_steps


def edge_uses(steps: DataFrame) -> DataFrame:
    """How often each directed edge is used: ``u, v, uses``."""
    return steps.groupBy("u", "v").agg(F.count(F.lit(1)).alias("uses"))


def use_share(steps: DataFrame, total: DataFrame) -> DataFrame:
    """Uses over the number of paths; ``total`` is a one-row, one-column table."""
    return edge_uses(steps).withColumn("centrality", F.col("uses") / total.scalar())


def path_edge_betweenness(paths: DataFrame) -> DataFrame:
    """Share of the given paths that use an edge: ``u, v, uses, centrality``."""
    return use_share(path_steps(paths), paths.agg(F.count(F.lit(1)).alias("paths")))


def attach_centrality(edges: DataFrame, centrality: DataFrame, key: str = "pair") -> DataFrame:
    """Write centrality onto edges; edges without a new value keep the old one.

    ``key="pair"`` joins on ``(u, v)``. ``key="way"`` gives every segment of a way
    the highest value found on it (``centrality`` then has ``way_id``).
    """
    if key not in ("pair", "way"):
        raise ValueError(f"unknown key {key!r}")
    on = ["u", "v"] if key == "pair" else ["way_id"]
    new = centrality.groupBy(*on).agg(F.max("centrality").alias("new_centrality"))
    old = F.col("centrality") if "centrality" in edges.columns else F.lit(None).cast("double")
    return edges.join(new, on, "left").withColumn(
        "centrality", F.coalesce("new_centrality", old)
    ).drop("new_centrality")


def with_centrality(edges: DataFrame) -> DataFrame:
    """Edges that carry a centrality."""
    return edges.filter(F.col("centrality").isNotNull())
