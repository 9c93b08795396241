"""The registered queries: every operator on the whole tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions import edge_label, iterate_map, iterate_map_pandas, road_latlon, split_label
from waymesh.operators import betweenness as between
from waymesh.operators import cache, cleaning, components, graph, importance, nearest, overlay, shaping, shortest, windows
from waymesh.operators.geometry import route_geometry as draw_routes
from waymesh.operators.levels import with_overlay
from waymesh.operators.requests import answer_requests as answer
from waymesh.operators.requests import misses_of, parse_requests as parse
from waymesh.operators.steps import path_steps as steps_of
from waymesh.operators.tiles import tile_edges
from waymesh.plans import derived, network, routes
from waymesh.runtime import checkpoint_root, store
from waymesh.sources import messages, osm, paths as path_files, tables
from waymesh.sources.path_store import PathStore
from waymesh.streaming import requests as job

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Size of the node sample of the path queries (a parameter of the sampling operator).
SAMPLE = 5

#: Edges per tile of the queries that run a search over many tiles; production tiles hold 65,536.
SMALL_TILE, WINDOW_TILE = 1024, 500


def _query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _steps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Steps of the derived paths and, as one row, the number of paths."""
    visits = store(derived.path_visits(spark, folder)).df
    steps = visits.na.drop(subset=["next_node"]).select("path_id", "pos", F.col("node").alias("u"), F.col("next_node").alias("v"))
    return steps, visits.filter("pos = 0").agg(F.count(F.lit(1)).alias("paths"))


def _middle(spark: SparkSession, folder: str) -> graph.Box:
    """The middle half of the map in both directions."""
    e = derived.nodes(spark, folder).agg(
        F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e")
    ).first()
    dy, dx = (e.n - e.s) / 4, (e.e - e.w) / 4
    return graph.Box(e.s + dy, e.w + dx, e.n - dy, e.e - dx)


def _plain(spark: SparkSession, folder: str) -> DataFrame:
    return store(derived.edges(spark, folder).select("u", "v", "cost_c")).df


def _fresh(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/waymesh/{uuid.uuid4().hex}"


def _by_place(spark: SparkSession, folder: str, edges: DataFrame) -> DataFrame:
    """``edges`` stored by the places of their ends, as map windows read them."""
    path = _fresh(spark)
    windows.save_edges_by_place(edges, derived.nodes(spark, folder), path)
    return windows.load_edges_by_place(spark, path)


def _text(column: str = "path"):
    return F.array_join(F.col(column).cast("array<string>"), ">").alias(column)


# paths and their importance


@_query
def path_edge_betweenness(spark, folder):
    return importance.use_share(*_steps(spark, folder))


@_query
def path_edge_label(spark, folder):
    uses = importance.edge_uses(_steps(spark, folder)[0])
    labelled = uses.select(edge_label("u", "v").alias("edge"), "uses")
    return labelled.withColumn("ends", split_label("edge")).select(
        "edge", "uses", F.col("ends.u").alias("u"), F.col("ends.v").alias("v")
    )


@_query
def path_steps(spark, folder):
    return steps_of(derived.whole_paths(spark, folder))


# cleaning


@_query
def class_speed_mean(spark, folder):
    parsed = derived.raw_edges(spark, folder).select(
        cleaning.first_class("highway").alias("highway"), cleaning.parse_speed("maxspeed").alias("speed")
    )
    return cleaning.class_speed_mean(parsed)


@_query
def clean_edges(spark, folder):
    return cleaning.clean_edges(derived.raw_edges(spark, folder)).select(
        "u", "v", "oneway", "highway", "length_m", "speed", "cost_c"
    )


@_query
def default_speed_cost(spark, folder):
    classes = F.array(*[F.lit(c) for c in derived.CLASSES])
    sizes = derived.nodes(spark, folder).select(F.col("id").alias("x"), "p_size")
    segments = derived.raw_edges(spark, folder).select(
        F.col("u").alias("x"), F.col("v").alias("y"), F.get("maxspeed", F.lit(0)).alias("maxspeed")
    ).join(sizes, "x").withColumn("highway", F.get(classes, F.col("p_size") % len(derived.CLASSES)))
    costs = cleaning.nonzero_cost(cleaning.segment_costs(segments, derived.osm_nodes(spark, folder)))
    return costs.select(
        "x", "y", "highway", "mph", F.floor(F.col("miles") * 1609.344 + 0.5).cast("bigint").alias("metres"),
        F.floor(F.col("weighted_dist") * 100 + 0.5).cast("bigint").alias("weighted_c"),
    )


@_query
def linestring_points(spark, folder):
    raw = derived.raw_edges(spark, folder).select("u", "v", cleaning.parse_linestring("geometry").alias("road"))
    return raw.select(
        "u", "v", F.size("road").alias("points"), F.get("road", F.lit(0)).lon.alias("lon1"),
        F.get("road", F.lit(0)).lat.alias("lat1"), F.get("road", F.lit(1)).lon.alias("lon2"),
        F.get("road", F.lit(1)).lat.alias("lat2"),
    )


@_query
def road_points_latlon(spark, folder):
    roads = derived.edges(spark, folder).select("u", "v", road_latlon("road").alias("points"))
    return roads.select("u", "v", F.posexplode("points").alias("pos", "p")).select(
        "u", "v", "pos", F.get("p", F.lit(0)).alias("lat"), F.get("p", F.lit(1)).alias("lon")
    )


@_query
def way_segments(spark, folder):
    return cleaning.way_segments(derived.road_ways(spark, folder)).select("way_id", "pos", "x", "y")


# graph tables


@_query
def directed_edges(spark, folder):
    return derived.edges(spark, folder).select("u", "v", "oneway", "cost_c")


@_query
def one_way_edges(spark, folder):
    return graph.one_way(derived.edges(spark, folder)).select("u", "v", "cost_c")


@_query
def node_count(spark, folder):
    return cleaning.node_count(cleaning.located(derived.nodes(spark, folder)))


@_query
def referenced_nodes(spark, folder):
    return cleaning.referenced_nodes(
        derived.osm_nodes(spark, folder), graph.one_way(derived.edges(spark, folder))
    ).select("id")


@_query
def edges_with_endpoints(spark, folder):
    known = derived.nodes(spark, folder).filter("p_size > 10")
    return cleaning.edges_with_endpoints(_plain(spark, folder), known)


@_query
def merge_nodes(spark, folder):
    every = derived.nodes(spark, folder)
    columns = ["id", "lat", "lon"]
    return cleaning.merge_nodes(
        every.filter("p_size > 20").select(*columns), every.select(*columns).unionByName(every.select(*columns))
    )


@_query
def simple_edges(spark, folder):
    return graph.simple_edges(derived.parallel_edges(spark, folder), directed=False)


@_query
def neighbors(spark, folder):
    return graph.neighbors(derived.nodes(spark, folder), derived.parallel_edges(spark, folder))


@_query
def node_sample(spark, folder):
    return graph.node_sample(derived.nodes(spark, folder), SAMPLE, "w")


@_query
def sample_pairs(spark, folder):
    return graph.distinct_pairs(graph.sample_pairs(derived.nodes(spark, folder), SAMPLE, "w"))


@_query
def bbox_subgraph(spark, folder):
    box = _middle(spark, folder)
    return graph.bbox_subgraph(
        derived.nodes(spark, folder), _by_place(spark, folder, derived.edges(spark, folder).select("u", "v", "cost_c")), (box.south, box.east), (box.north, box.west)
    )


@_query
def edges_in_box(spark, folder):
    placed = _by_place(spark, folder, derived.edges(spark, folder).select("u", "v", "cost_c"))
    return graph.edges_in_box(derived.nodes(spark, folder), placed, _middle(spark, folder))


# nearest nodes and requests


@_query
def nearest_node_batch(spark, folder):
    points = derived.requests(spark, folder).select("request_id", "lat1", "lng1")
    found = nearest.nearest_node(points, derived.nodes(spark, folder), "lat1", "lng1")
    return found.select("request_id", "node", F.floor(F.col("dist_m") + 0.5).cast("bigint").alias("metres"))


@_query
def nearest_node_single(spark, folder):
    found = nearest.nearest_to(derived.nodes(spark, folder), 46.218040530022094, -117.88330078125001)
    return found.select("id", F.floor(F.col("dist_m") + 0.5).cast("bigint").alias("metres"))


@_query
def parse_requests(spark, folder):
    return parse(derived.request_messages(spark, folder))


@_query
def answer_requests(spark, folder):
    requests = parse(derived.request_messages(spark, folder))
    answers = answer(requests, derived.nodes(spark, folder), derived.cached_paths(spark, folder))
    return answers.select("request_id", "node1", "node2", "cost_c", "hops", "status")


@_query
def queued_messages(spark, folder):
    requests = parse(derived.request_messages(spark, folder))
    answers = answer(requests, derived.nodes(spark, folder), derived.cached_paths(spark, folder))
    return messages.miss_messages(misses_of(answers))


# shortest paths and the cache


@_query
def sssp_sample(spark, folder):
    sources = graph.node_sample(derived.nodes(spark, folder), SAMPLE, "w").select(F.col("id").alias("source"))
    return shortest.sssp(_plain(spark, folder), sources)


@_query
def shortest_paths_sample(spark, folder):
    pairs = graph.sample_pairs(derived.nodes(spark, folder), SAMPLE, "w")
    found = shortest.shortest_paths(_plain(spark, folder), pairs)
    return found.select("node1", "node2", "cost_c", "hops", _text())


@_query
def route_pairs(spark, folder):
    pairs = store(graph.sample_pairs(derived.nodes(spark, folder), SAMPLE, "w")).df
    edges = _plain(spark, folder)
    known = store(shortest.shortest_paths(edges, pairs.filter("node1 < node2"))).df
    answers, _ = shortest.route_pairs(pairs, edges, known)
    return answers.select("node1", "node2", "cost_c", "hops", _text())


def _tiled(spark: SparkSession, folder: str):
    """The edges cut by place into many small tiles."""
    return tile_edges(_plain(spark, folder), derived.nodes(spark, folder), per_tile=SMALL_TILE)


@_query
def sssp_tiled(spark, folder):
    sources = graph.node_sample(derived.nodes(spark, folder), SAMPLE, "w").select(F.col("id").alias("source"))
    return shortest.sssp(with_overlay(_tiled(spark, folder), derived.nodes(spark, folder)), sources)


@_query
def shortest_paths_tiled(spark, folder):
    pairs = graph.sample_pairs(derived.nodes(spark, folder), SAMPLE, "w")
    found = shortest.shortest_paths(with_overlay(_tiled(spark, folder), derived.nodes(spark, folder)), pairs)
    return found.select("node1", "node2", "cost_c", "hops", _text())


@_query
def route_pairs_tiled(spark, folder):
    pairs = store(graph.sample_pairs(derived.nodes(spark, folder), SAMPLE, "w")).df
    tiles = with_overlay(_tiled(spark, folder), derived.nodes(spark, folder))
    known = store(shortest.shortest_paths(tiles, pairs.filter("node1 < node2"))).df
    answers, _ = shortest.route_pairs(pairs, tiles, known)
    return answers.select("node1", "node2", "cost_c", "hops", _text())


@_query
def publish_importance(spark, folder):
    edges = _plain(spark, folder)
    pairs = graph.sample_pairs(derived.nodes(spark, folder), SAMPLE, "w")
    found = store(shortest.shortest_paths(edges, pairs)).df
    return routes.publish_importance(edges, found)


@_query
def route_cache_hits(spark, folder):
    hits = cache.cache_hits(derived.request_pairs(spark, folder), derived.cached_paths(spark, folder))
    return hits.select("request_id", "node1", "node2", "cost_c", "hops", _text())


@_query
def route_cache_misses(spark, folder):
    return cache.cache_misses(derived.request_pairs(spark, folder), derived.cached_paths(spark, folder))


@_query
def cache_stats(spark, folder):
    return cache.cache_stats(derived.cached_paths(spark, folder))


@_query
def paths_from_string(spark, folder):
    paths = derived.whole_paths(spark, folder)
    as_text = F.concat(F.lit("["), F.array_join(F.col("path").cast("array<string>"), ", "), F.lit("]"))
    odd = F.col("path_id") % 2 == 1
    docs = paths.select(
        "node1", "node2", F.when(odd, F.col("path")).alias("path"), F.when(~odd, as_text).alias("path_text")
    )
    return cache.read_paths(docs).groupBy("node1", "node2", _text()).agg(F.count(F.lit(1)).alias("times"))


@_query
def path_export_roundtrip(spark, folder):
    back = path_files.parse_export(path_files.export_entries(derived.whole_paths(spark, folder)))
    return back.groupBy("node1", "node2", _text()).agg(F.count(F.lit(1)).alias("times"), F.countDistinct("path_id").alias("keys"))


@_query
def path_log_parse(spark, folder):
    listed = F.array_join(F.col("path").cast("array<string>"), ", ")
    lines = derived.whole_paths(spark, folder).select(F.concat(
        F.lit("{_id: 1, node1: "), F.col("node1").cast("string"), F.lit(", node2: "), F.col("node2").cast("string"),
        F.lit(", path: ["), listed, F.lit("]}"),
    ).alias("value"))
    return path_files.parse_path_log(lines).groupBy("node1", "node2", _text()).agg(F.count(F.lit(1)).alias("times"))


@_query
def route_geometry(spark, folder):
    lines = draw_routes(derived.whole_paths(spark, folder), derived.edges(spark, folder))
    first, last = F.get("line", F.lit(0)), F.try_element_at("line", F.lit(-1))
    return lines.select(
        "path_id", "steps", F.size("line").alias("points"), F.get(first, 0).alias("lat1"), F.get(first, 1).alias("lon1"),
        F.get(last, 0).alias("lat2"), F.get(last, 1).alias("lon2"),
    )


# exact centrality


def _rounded(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


@_query
def edge_betweenness(spark, folder):
    found = between.edge_betweenness(_plain(spark, folder))
    return found.select("u", "v", _rounded("credit"), _rounded("betweenness", 9))


@_query
def node_betweenness(spark, folder):
    found = between.node_betweenness(_plain(spark, folder))
    return found.select("node", _rounded("credit"), _rounded("betweenness", 9))


def _window_tiles(spark: SparkSession, folder: str):
    """The sub-network of the map window, both directions, cut into many tiles."""
    sub = graph.simple_edges(edges_in_box(spark, folder), directed=False)
    both = sub.unionByName(sub.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost_c"))
    return tile_edges(both, derived.nodes(spark, folder), per_tile=WINDOW_TILE)


@_query
def edge_betweenness_window(spark, folder):
    found = between.edge_betweenness(_window_tiles(spark, folder), directed=False)
    return found.select("u", "v", _rounded("credit"), _rounded("betweenness", 9))


@_query
def node_betweenness_window(spark, folder):
    found = between.node_betweenness(_window_tiles(spark, folder), directed=False)
    return found.select("node", _rounded("credit"), _rounded("betweenness", 9))


@_query
def all_pairs_score_window(spark, folder):
    return between.all_pairs_edge_score(_window_tiles(spark, folder)).select("u", "v", _rounded("score"))


@_query
def all_pairs_edge_score(spark, folder):
    edges = _plain(spark, folder)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost_c"))
    return between.all_pairs_edge_score(both).select("u", "v", _rounded("score"))


@_query
def attach_centrality(spark, folder):
    edges = derived.edges_with_centrality(spark, folder).select("u", "v", "cost_c", "centrality")
    new = importance.use_share(*_steps(spark, folder)).select("u", "v", "centrality")
    return importance.attach_centrality(edges, new)


@_query
def attach_centrality_way(spark, folder):
    edges = derived.edges_with_centrality(spark, folder).withColumn("way_id", F.floor(F.col("u") / 3))
    new = edges.filter("cost_c > 800").select("way_id", (F.col("centrality") + 1).alias("centrality"))
    return importance.attach_centrality(edges, new, key="way").select("u", "v", "way_id", "centrality")


@_query
def window_importance(spark, folder):
    edges = derived.edges(spark, folder).select("u", "v", "cost_c", F.floor(F.col("u") / 3).alias("way_id"))
    drawn, points = routes.window_importance(
        derived.nodes(spark, folder), _by_place(spark, folder, edges), _middle(spark, folder), per_tile_edges=WINDOW_TILE
    )
    nothing = F.lit(None).cast("bigint")
    return drawn.select(F.lit("edge").alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), "way_id", _rounded("centrality", 9)).unionByName(
        points.select(F.lit("node").alias("kind"), F.col("id").alias("a"), nothing.alias("b"), nothing.alias("way_id"), _rounded("centrality", 9))
    )


# overlay


def _overlay(spark: SparkSession, folder: str) -> DataFrame:
    edges = _by_place(spark, folder, derived.edges_with_centrality(spark, folder).select("u", "v", "centrality"))
    return overlay.centrality_in_window(derived.nodes(spark, folder), edges, _middle(spark, folder))


@_query
def centrality_in_window(spark, folder):
    return _overlay(spark, folder)


@_query
def window_stats(spark, folder):
    stats = overlay.window_stats(_overlay(spark, folder))
    return stats.select(F.round("mean_c", 9).alias("mean_c"), "min_c", "max_c")


@_query
def window_q3(spark, folder):
    return overlay.upper_half_median(_overlay(spark, folder))


@_query
def above_q3(spark, folder):
    return overlay.above_q3(store(_overlay(spark, folder)).df)


@_query
def overlay_colors(spark, folder):
    return overlay.overlay_colors(store(_overlay(spark, folder)).df)


# shaping


@_query
def connected_components(spark, folder):
    return components.connected_components(derived.cut_edges(spark, folder), derived.nodes(spark, folder))


@_query
def largest_component(spark, folder):
    return components.largest_component(
        components.connected_components(derived.cut_edges(spark, folder), derived.nodes(spark, folder))
    )


@_query
def consolidate_nodes(spark, folder):
    nodes, _ = shaping.consolidate(*derived.twin_network(spark, folder), tol_m=40)
    return nodes.select("id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "merged")


@_query
def consolidate_edges(spark, folder):
    return shaping.consolidate(*derived.twin_network(spark, folder), tol_m=40)[1]


@_query
def simplify_chains(spark, folder):
    return shaping.simplify_chains(derived.sparse_edges(spark, folder)).select(
        "u", "v", "length_m", "cost_c", "pieces",
        F.array_join("highway", ",").alias("highway"), F.array_join("maxspeed", ",").alias("maxspeed"),
    )


@_query
def drivable_network(spark, folder):
    _, edges = network.drivable_network(derived.osm_ways(spark, folder), derived.osm_nodes(spark, folder))
    return edges.select(
        "u", "v", "way_id", "highway", "oneway", "speed", F.floor(F.col("length_m") + 0.5).cast("bigint").alias("metres")
    )


@_query
def network_v2(spark, folder):
    _, roads = network.simplified_network(derived.road_ways(spark, folder), derived.osm_nodes(spark, folder))
    second = F.get("road", F.lit(1))
    return roads.select(
        "u", "v", "pieces", "highway", F.array_join("highways", ",").alias("highways"), "speed", "cost_c", "oneway",
        F.floor(F.col("length_m") + 0.5).cast("bigint").alias("metres"), F.size("road").cast("bigint").alias("points"),
        second["lon"].alias("lon2"), second["lat"].alias("lat2"),
        F.concat_ws(">", F.transform("way_ids", lambda w: w.cast("string"))).alias("way_ids"), F.concat_ws(">", "names").alias("names"),
    )


# sources: written from the tables, read back by the operators


def _extract(elements: DataFrame) -> str:
    """Write ``id, element`` as an extract in files of up to 5,000 ids, each a document of its own."""
    path = _fresh(elements.sparkSession)
    bodies = elements.groupBy(F.floor(F.col("id") / 5000).alias("part")).agg(F.array_join(F.collect_list("element"), "\n").alias("body"))
    bodies.select("part", F.concat(F.lit("<osm>\n"), "body", F.lit("\n</osm>")).alias("value")).write.partitionBy("part").text(path)
    return path


@_query
def osm_xml_nodes(spark, folder):
    """Nodes of an extract; every fifth has a tag."""
    tag = F.when(F.col("id") % 5 == 0, F.format_string('<tag k="highway" v="%s"/>', F.lower(F.substring_index("p_type", " ", 1)))).otherwise("")
    element = F.format_string('<node id="%d" lat="%s" lon="%s">%s</node>', "id", F.col("lat").cast("string"), F.col("lon").cast("string"), tag)
    path = _extract(derived.nodes(spark, folder).select("id", element.alias("element")))
    return osm.read_osm_nodes(spark, path).select("id", "lat", "lon", F.col("tags")["highway"].alias("highway"))


@_query
def osm_xml_ways(spark, folder):
    """Ways of an extract with their nodes in order."""
    refs = F.array_join(F.transform("nd", lambda n: F.format_string('<nd ref="%d"/>', n)), "")
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda t: F.format_string('<tag k="%s" v="%s"/>', t["key"], t["value"])), "")
    element = F.format_string('<way id="%d">%s%s</way>', "way_id", refs, tags)
    path = _extract(derived.road_ways(spark, folder).select(F.col("way_id").alias("id"), element.alias("element")))
    return osm.read_osm_ways(spark, path).select(
        "way_id", F.concat_ws(">", F.transform("nd", lambda n: n.cast("string"))).alias("nd"),
        F.col("tags")["highway"].alias("highway"), F.col("tags")["maxspeed"].alias("maxspeed"), F.col("tags")["name"].alias("name"),
    )


@_query
def load_nodes_csv(spark, folder):
    """Nodes from a CSV file, merged into a stored table that already holds some of them."""
    nodes = derived.nodes(spark, folder).select("id", "lat", "lon")
    csv, stored = _fresh(spark), _fresh(spark)
    tables.write_csv(nodes.select(F.col("id").alias("osmid"), F.col("lat").alias("y"), F.col("lon").alias("x")), csv)
    tables.save_nodes(nodes.filter("id % 3 = 0"), stored)
    return tables.load_nodes(spark, csv, spark.read.parquet(stored), version=2)


def _faulty_nodes(spark, folder) -> str:
    """A CSV file of the nodes in which some lines have faults of their own."""
    path = _fresh(spark)
    tables.write_csv(derived.nodes(spark, folder).select(
        F.when(F.col("id") % 11 == 3, F.concat(F.lit("n"), "id")).otherwise(F.col("id").cast("string")).alias("osmid"),
        F.when(F.col("id") % 7 == 1, F.lit("north")).when(F.col("id") % 7 == 2, F.lit("91.5")).otherwise(F.col("lat").cast("string")).alias("y"),
        F.when(F.col("id") % 13 != 4, F.col("lon")).alias("x"),
    ), path)
    return path


@_query
def csv_judged(spark, folder):
    """Every line of a faulty CSV file with what is wrong with it."""
    judged = tables.judged_csv(spark, _faulty_nodes(spark, folder), "nodes")
    return judged.select("osmid", F.col("y").alias("lat"), F.col("x").alias("lon"), F.array_join("reasons", ",").alias("reasons"))


@_query
def csv_loaded_and_rejected(spark, folder):
    """Nodes loaded from a faulty CSV file, and beside them the counted reasons of the lines kept apart."""
    rejects = _fresh(spark)
    loaded = tables.load_nodes(spark, _faulty_nodes(spark, folder), version=2, rejects=rejects)
    counted = spark.read.parquet(rejects).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
    return counted.unionByName(loaded.agg(F.lit("loaded").alias("reason"), F.count(F.lit(1)).alias("lines")))


@_query
def load_edges_csv(spark, folder):
    """Edges of the second version from a CSV file, with their lines."""
    path = _fresh(spark)
    tables.write_csv(derived.edges(spark, folder).select("u", "v", "oneway", (F.col("cost_c") / 100).alias("weighted_distance"), "road"), path)
    first = F.get("road", F.lit(0))
    return tables.read_edges_csv(spark, path).select(
        "u", "v", F.col("oneway").cast("boolean").alias("oneway"), "cost_c", F.size("road").alias("points"), first["lon"].alias("lon"), first["lat"].alias("lat")
    )


@_query
def stored_edges(spark, folder):
    """Edges stored twice over, only those of which both ends are stored nodes."""
    path = _fresh(spark)
    edges, nodes = _plain(spark, folder), derived.nodes(spark, folder)
    tables.save_edges(edges, nodes, path)
    tables.save_edges(edges, nodes.filter("id % 10 <> 0"), path)
    return spark.read.parquet(path).select("u", "v", "cost_c")


@_query
def appended_paths(spark, folder):
    """The cache after the same paths, some twice, came in two overlapping loads."""
    path = _fresh(spark)
    known = store(derived.cached_paths(spark, folder)).df
    path_files.append_paths(known.filter("node1 % 2 = 0"), path)
    path_files.append_paths(known, path)
    return path_files.open_cache(spark, path).select("node1", "node2", "cost_c", "hops", _text())


@_query
def partitioned_cache_lookup(spark, folder):
    """Requested pairs looked up in a cache of hash partitions: loaded, a load repeated, and compacted before."""
    paths = PathStore(spark, _fresh(spark))
    known = store(derived.cached_paths(spark, folder)).df
    pairs = store(derived.request_pairs(spark, folder)).df
    paths.append(known, "all")
    paths.append(known.filter("hops = 2"), "dearer")
    paths.append(known.filter("hops = 2"), "dearer")
    paths.compact()
    paths.append(known.limit(0), "none", asked=cache.cache_misses(pairs, known))
    found = pairs.join(paths.lookup(pairs), ["node1", "node2"], "left")
    status = F.when(F.col("path").isNull(), "no path").otherwise("found")
    return found.select("request_id", "node1", "node2", "cost_c", "hops", status.alias("status"))


@_query
def streamed_requests(spark, folder):
    """Requests that arrived as a stream of messages, parsed on the way and appended to a table."""
    topic, out = _fresh(spark), _fresh(spark)
    ids = F.regexp_replace("value", r"^\{", F.concat(F.lit('{"request_id":'), F.col("request_id").cast("string"), F.lit(",")))
    derived.request_messages(spark, folder).select(ids).write.text(topic)
    stream = parse(messages.read_requests(spark, "text", path=topic))
    job.start(stream, "parquet", checkpoint=_fresh(spark), path=out, available_now=True).awaitTermination()
    return spark.read.parquet(out).withColumn("request_id", F.col("request_id").cast("bigint"))


# load test


@_query
def iterate_map_native(spark, folder):
    events = derived.table(spark, folder, "events")
    return events.select("event_id", iterate_map(F.col("value") / 1000).alias("result"))


@_query
def iterate_map_vectorised(spark, folder):
    events = derived.table(spark, folder, "events")
    return events.select("event_id", iterate_map_pandas(F.col("value") / 1000).alias("result"))
