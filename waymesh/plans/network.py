"""From an OpenStreetMap extract to a routable network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.cleaning import is_oneway
from waymesh.functions.geo import geo_distance
from waymesh.functions.text import project_tags
from waymesh.operators.cleaning import (
    attach_points, clean_edges, nonzero_cost, referenced_nodes, routable, segment_costs, tagged_ways, way_segments,
)
from waymesh.operators.components import keep_largest
from waymesh.operators.graph import Box, directed_edges, edges_in_box
from waymesh.operators.shaping import simplify_chains
from waymesh.runtime import store

# Road classes a car does not use.
NOT_DRIVABLE = [
    "abandoned", "bridleway", "bus_guideway", "construction", "corridor", "cycleway", "elevator", "escalator",
    "footway", "no", "path", "pedestrian", "planned", "platform", "proposed", "raceway", "razed", "service",
    "steps", "track",
]


def drivable_ways(ways: DataFrame) -> DataFrame:
    """Roads a car may use; needs ``highway`` and, if known, ``access`` and ``motor_vehicle``."""
    kept = tagged_ways(ways).filter(~F.col("highway").isin(NOT_DRIVABLE))
    for column, barred in (("access", "private"), ("motor_vehicle", "no")):
        if column in ways.columns:
            kept = kept.filter(F.col(column).isNull() | (F.col(column) != barred))
    return kept


def way_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Raw edges of ways with ``nd`` and tag columns: ends, way id, class, speed, length, points."""
    placed = attach_points(way_segments(ways), nodes)
    point = lambda side: F.struct(F.col(f"lon_{side}").alias("lon"), F.col(f"lat_{side}").alias("lat"))
    known = F.col("maxspeed").isNotNull()
    return placed.select(
        F.col("x").alias("u"), F.col("y").alias("v"), "way_id", "name",
        F.split("highway", ";").alias("highway"),
        F.when(known, F.split("maxspeed", ";")).alias("maxspeed"),
        is_oneway("oneway").alias("oneway"),
        geo_distance("lat_x", "lon_x", "lat_y", "lon_y").alias("length_m"),
        F.array(point("x"), point("y")).alias("road"),
    )


def with_way_tags(ways: DataFrame) -> DataFrame:
    return project_tags(ways, ["highway", "name", "maxspeed", "oneway", "access", "motor_vehicle"])


def drivable_network(ways: DataFrame, nodes: DataFrame, box: Box | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and undirected road rows of the largest connected drivable network in a box.

    ``ways`` and ``nodes`` come from :mod:`waymesh.sources.osm`. A road whose class has no
    known speed stays, with a NULL cost: it joins parts of the network all the same.
    The result feeds ``routing_edges``.
    """
    raw = way_edges(drivable_ways(with_way_tags(ways)), nodes.select("id", "lat", "lon"))
    if box is not None:
        raw = edges_in_box(nodes, raw, box)
    # the extract is parsed and joined once, the clean table read several times below
    edges = store(clean_edges(store(raw).df)).df
    used = referenced_nodes(nodes.select("id", "lat", "lon"), edges)
    return keep_largest(used, edges)


def simplified_network(ways: DataFrame, nodes: DataFrame, box: Box | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and directed roads of the largest connected drivable network, chains contracted before they are priced.

    A road runs from junction to junction (or dead end): ``u, v, length_m, pieces, highway`` (first of its sorted
    classes), ``highways, speed, cost_c, oneway, road`` (points in driving order), ``way_ids, names``. The class mean of
    speeds counts contracted roads, both directions of a two-way one.
    """
    raw = way_edges(drivable_ways(with_way_tags(ways)), nodes.select("id", "lat", "lon"))
    if box is not None:
        raw = edges_in_box(nodes, raw, box)
    # a way that takes the same step twice has one piece for it
    pieces = store(directed_edges(raw)).df.dropDuplicates(["u", "v", "way_id"])
    roads = simplify_chains(pieces).withColumn("highways", F.col("highway"))
    edges = store(clean_edges(store(roads).df)).df
    return keep_largest(referenced_nodes(nodes.select("id", "lat", "lon"), edges), edges)


def routing_edges(edges: DataFrame) -> DataFrame:
    """Directed edges with a cost, ready for path searches."""
    return directed_edges(routable(edges))


def first_version_tables(ways: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first-version node and edge tables: speed times miles per segment, zero costs dropped."""
    segments = way_segments(tagged_ways(with_way_tags(ways)))
    edges = nonzero_cost(segment_costs(segments, nodes.select("id", "lat", "lon")))
    edges = edges.select(
        F.col("way_id").alias("osmid_x"), "x", "y", "name", "weighted_dist", "oneway", "highway"
    )
    used = referenced_nodes(nodes, edges.select(F.col("x").alias("u"), F.col("y").alias("v")))
    return used.select(F.col("id").alias("osmid"), "lat", "lon"), edges
