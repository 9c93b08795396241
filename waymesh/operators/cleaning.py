"""From raw ways and segments to a clean, weighted road table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.cleaning import default_speed, first_class, is_oneway, parse_speed, travel_cost, weighted_dist
from waymesh.functions.geo import geo_distance, line_text, parse_linestring
from waymesh.runtime import small


def way_segments(ways: DataFrame) -> DataFrame:
    """One row per pair of consecutive nodes of a way (``nd`` is its node list).

    The pairs come out of the row itself, so nothing is shuffled. A way with
    fewer than two nodes gives no row.
    """
    other = [c for c in ways.columns if c != "nd"]
    pairs = F.zip_with(
        F.slice("nd", 1, F.greatest(F.size("nd") - 1, F.lit(0))),
        F.slice("nd", 2, F.greatest(F.size("nd") - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("x"), b.alias("y")),
    )
    return (
        ways.filter(F.size("nd") > 1)
        .select(*other, F.posexplode(pairs).alias("pos", "pair"))
        .select(*other, "pos", "pair.x", "pair.y")
    )


def tagged_ways(ways: DataFrame) -> DataFrame:
    """Only ways with a ``highway`` tag are roads."""
    return ways.filter(F.col("highway").isNotNull())


def located(nodes: DataFrame) -> DataFrame:
    """Nodes with both coordinates."""
    return nodes.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def attach_points(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Coordinates of both ends (``x``, ``y`` are node ids); inner on both sides."""
    start = nodes.select(F.col("id").alias("x"), F.col("lat").alias("lat_x"), F.col("lon").alias("lon_x"))
    end = nodes.select(F.col("id").alias("y"), F.col("lat").alias("lat_y"), F.col("lon").alias("lon_y"))
    return segments.join(start, "x").join(end, "y")


def segment_costs(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """First-version edges: miles, default speed, speed times miles and a line text.

    ``segments`` needs ``x``, ``y``, ``highway`` and ``maxspeed`` (raw text).
    """
    placed = attach_points(segments, nodes)
    return (
        placed.withColumn("line", line_text("lat_x", "lon_x", "lat_y", "lon_y"))
        .withColumn("miles", geo_distance("lat_x", "lon_x", "lat_y", "lon_y", "mi"))
        .withColumn("mph", default_speed("highway", "maxspeed"))
        .withColumn("weighted_dist", weighted_dist("mph", "miles"))
        .drop("lat_x", "lon_x", "lat_y", "lon_y")
    )


def nonzero_cost(edges: DataFrame, cost: str = "weighted_dist") -> DataFrame:
    """Edges with a cost other than zero."""
    return edges.filter(F.col(cost) != 0)


def class_speed_mean(edges: DataFrame) -> DataFrame:
    """Truncated mean of the known speeds per class: ``highway, class_speed``."""
    return (
        edges.filter(F.col("speed").isNotNull())
        .groupBy("highway")
        .agg(F.avg("speed").cast("int").alias("class_speed"))
    )


def impute_speed(edges: DataFrame) -> DataFrame:
    """Fill missing speeds with the mean of the class.

    The means are one row per road class; they are broadcast if that proves
    small, which also keeps the dominant class from landing in one task.
    """
    means = small(class_speed_mean(edges))
    return edges.join(means, "highway", "left").withColumn(
        "speed", F.coalesce("speed", "class_speed")
    ).drop("class_speed")


def clean_edges(raw: DataFrame) -> DataFrame:
    """Raw segments (lists of classes and speeds, WKT geometry) to clean edges.

    An edge whose class has no known speed keeps a NULL cost; see :func:`routable`.
    """
    parsed = (
        raw.withColumn("highway", first_class("highway"))
        .withColumn("speed", parse_speed("maxspeed"))
        .withColumn("oneway", is_oneway("oneway"))
        .drop("maxspeed")
    )
    if "geometry" in raw.columns:
        parsed = parsed.withColumn("road", parse_linestring("geometry")).drop("geometry")
    return impute_speed(parsed).withColumn("cost_c", travel_cost("length_m", "speed"))


def routable(edges: DataFrame) -> DataFrame:
    """Edges with a known cost."""
    return edges.filter(F.col("cost_c").isNotNull())


def referenced_nodes(nodes: DataFrame, edges: DataFrame, include_isolated: bool = False) -> DataFrame:
    """Nodes that are an end of some edge."""
    if include_isolated:
        return nodes
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi")


def edges_with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    known = nodes.select("id")
    return (
        edges.join(known, edges["u"] == known["id"], "left_semi")
        .join(known, edges["v"] == known["id"], "left_semi")
    )


def merge_nodes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert if absent: ``existing`` and each new ``(id, lat, lon)`` it lacks."""
    keys = ["id", "lat", "lon"]
    fresh = new.select(*keys).dropDuplicates(keys)
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    missing = fresh.alias("n").join(existing.select(*keys).alias("e"), same[0] & same[1] & same[2], "left_anti")
    return existing.select(*keys).unionByName(missing)


def node_count(nodes: DataFrame) -> DataFrame:
    """One row: the number of nodes."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes"))
