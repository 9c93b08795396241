import random

import pytest
from pyspark.sql import functions as F

from waymesh.operators import cache, cleaning, graph, importance, steps
from waymesh.operators.geometry import route_geometry
from waymesh.sources import tables


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_segments_of_ways(spark):
    ways = spark.createDataFrame([(1, [5, 6, 7]), (2, [8]), (3, []), (4, None), (5, [9, 9])], "way_id long, nd array<long>")
    assert pairs(cleaning.way_segments(ways), "way_id", "pos", "x", "y") == [(1, 0, 5, 6), (1, 1, 6, 7), (5, 0, 9, 9)]


def test_impute_keeps_unknown_classes_missing(spark):
    raw = spark.createDataFrame(
        [(1, 2, ["a"], ["20 mph"]), (2, 3, ["a"], ["31 mph"]), (3, 4, ["a", "b"], None), (4, 5, ["c"], ["none"])],
        "u long, v long, highway array<string>, maxspeed array<string>",
    ).withColumns({"oneway": F.lit("no"), "length_m": F.lit(100.0)})
    got = {(r.u, r.speed, r.cost_c) for r in cleaning.clean_edges(raw).collect()}
    assert got == {(1, 20, 500), (2, 31, 323), (3, 25, 400), (4, None, None)}
    assert cleaning.routable(cleaning.clean_edges(raw)).count() == 3


def test_endpoints_and_references(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, None, 1.0)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2), (2, 9)], "u long, v long")
    assert pairs(cleaning.edges_with_endpoints(edges, nodes), "u", "v") == [(1, 2)]
    assert pairs(cleaning.referenced_nodes(nodes, edges), "id") == [(1,), (2,)]
    assert cleaning.referenced_nodes(nodes, edges, include_isolated=True).count() == 3
    assert pairs(cleaning.located(nodes), "id") == [(1,), (2,)]
    assert cleaning.node_count(nodes).first().nodes == 3


def test_merge_inserts_only_what_is_absent(spark):
    schema = "id long, lat double, lon double"
    old = spark.createDataFrame([(1, 1.0, 1.0)], schema)
    new = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (2, 1.0, 1.0), (1, 1.0, 2.0)], schema)
    assert pairs(cleaning.merge_nodes(old, new), "id", "lon") == [(1, 1.0), (1, 2.0), (2, 1.0)]


def test_lines_with_faults_are_kept_apart(spark, tmp_path):
    path, rejects = tmp_path / "nodes.csv", str(tmp_path / "rejects")
    path.write_text("note,osmid,y,x\n-,1,1.5,2.5\n-,,1,2\n-,x2,north,2\n-,3,-90.5,NaN\n-,4,1\n-,5,1,2,9\n\"a,b\",6,-90,180\n")
    judged = {r.row: r.reasons for r in tables.judged_csv(spark, str(path), "nodes").collect()}
    assert judged == {
        "-,1,1.5,2.5": [], "-,,1,2": ["osmid missing"], "-,x2,north,2": ["osmid type", "y type"], "-,3,-90.5,NaN": ["y range", "x range"],
        "-,4,1": ["fields"], "-,5,1,2,9": ["fields"], '"a,b",6,-90,180': [],
    }
    assert pairs(tables.load_nodes(spark, str(path), version=2, rejects=rejects), "id", "lat", "lon") == [(1, 1.5, 2.5), (6, -90.0, 180.0)]
    assert spark.read.parquet(rejects).count() == 5
    with pytest.raises(ValueError, match="has no column lat, lon"):
        tables.judged_csv(spark, str(path), "nodes", 1)
    empty = tmp_path / "empty.csv"
    empty.write_text("osmid,y,x\n")
    assert tables.judged_csv(spark, str(empty), "nodes").count() == 0


def test_directed_and_simple_edges(spark):
    road = [(0.0, 1.0), (2.0, 3.0)]
    edges = spark.createDataFrame(
        [(1, 2, True, 5, road), (2, 3, False, 7, road), (3, 2, False, 6, road), (4, 4, False, 1, road)],
        "u long, v long, oneway boolean, cost_c long, road array<struct<lon:double,lat:double>>",
    )
    both = graph.directed_edges(edges)
    assert pairs(both.filter("u <> v"), "u", "v", "cost_c") == [(1, 2, 5), (2, 3, 6), (2, 3, 7), (3, 2, 6), (3, 2, 7)]
    back = both.filter("u = 3 and cost_c = 7").first().road
    assert [(p.lon, p.lat) for p in back] == road[::-1]
    assert pairs(graph.simple_edges(both.drop("road")), "u", "v", "cost_c") == [(1, 2, 5), (2, 3, 6), (3, 2, 6)]
    assert pairs(graph.simple_edges(both.drop("road"), directed=False), "u", "v", "cost_c") == [(1, 2, 5), (2, 3, 6)]
    assert graph.edges_to(edges, 2).count() == 2
    assert graph.one_way(edges).count() == 1


def test_neighbors_are_distinct(spark):
    edges = spark.createDataFrame([(1, 2, 5), (1, 2, 5), (1, 3, 4), (2, 1, 1)], "u long, v long, cost_c long")
    nodes = spark.createDataFrame([(1,), (1,)], "id long")
    assert pairs(graph.neighbors(nodes, edges), "id", "next", "cost_c") == [(1, 2, 5), (1, 3, 4)]


@pytest.mark.parametrize("k", [0, 1, 2, 5, 50])
def test_sample_pairs(spark, k):
    nodes = spark.range(20)
    drawn = [r.id for r in graph.node_sample(nodes, k, "s").collect()]
    assert len(drawn) == len(set(drawn)) == min(k, 20)
    assert drawn == [r.id for r in graph.node_sample(nodes.repartition(3), k, "s").collect()]
    got = pairs(graph.sample_pairs(nodes, k, "s"), "node1", "node2")
    assert got == sorted((a, b) for a in drawn for b in drawn if a != b)


def test_box(spark):
    nodes = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 2.00001, 1.0)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2, 3), (2, 1, 2), (2, 3, 1)], "u long, v long, cost_c long")
    assert pairs(graph.edges_in_box(nodes, edges, graph.Box(1, 1, 2, 2)), "u", "v") == [(1, 2), (2, 1)]
    got = graph.bbox_subgraph(nodes, edges, (2.0, 1.0), (1.0, 2.0), grow=False)
    assert pairs(got, "u", "v", "cost_c") == [(1, 2, 2)]
    assert pairs(graph.bbox_subgraph(nodes, edges, (2.0, 1.0), (1.0, 2.0)), "u", "v", "cost_c") == [(1, 2, 2), (2, 3, 1)]
    with pytest.raises(ValueError):
        graph.Box(2, 0, 1, 1)


def test_ordered_steps_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(7 if i % 3 else i, rng.random(), i, rng.randint(0, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, t double, e long, node long").repartition(5)
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(mine):
            want[r[2]] = (i, mine[i + 1][3] if i + 1 < len(mine) else None)
    got = {r.e: (r.pos, r.next_node) for r in steps.ordered_steps(df, ["k"], ["t", "e"], "node").collect()}
    assert got == want


def test_path_importance_counts_paths_of_one_pair_apart(spark):
    paths = spark.createDataFrame(
        [("a", [1, 2, 3]), ("b", [1, 2, 3]), ("c", [1, 3]), ("d", [4]), ("e", [])], "path_id string, path array<long>"
    )
    got = importance.path_edge_betweenness(paths)
    assert pairs(got, "u", "v", "uses", "centrality") == [(1, 2, 2, 0.4), (1, 3, 1, 0.2), (2, 3, 2, 0.4)]
    walked = steps.path_steps(paths)
    assert walked.count() == 5
    assert pairs(walked.filter("path_id = 'a'"), "pos", "u", "v") == [(0, 1, 2), (1, 2, 3)]


def test_attach_centrality(spark):
    edges = spark.createDataFrame([(1, 2, 9, 0.5), (2, 3, 9, None), (3, 4, 8, 0.1)], "u long, v long, way_id long, centrality double")
    by_pair = spark.createDataFrame([(1, 2, 0.7), (9, 9, 1.0)], "u long, v long, centrality double")
    assert pairs(importance.attach_centrality(edges, by_pair).na.fill(-1.0), "u", "centrality") == [(1, 0.7), (2, -1.0), (3, 0.1)]
    by_way = spark.createDataFrame([(9, 0.2), (9, 0.6)], "way_id long, centrality double")
    got = importance.attach_centrality(edges, by_way, key="way")
    assert pairs(got, "u", "centrality") == [(1, 0.6), (2, 0.6), (3, 0.1)]
    assert importance.with_centrality(edges).count() == 2
    with pytest.raises(ValueError):
        importance.attach_centrality(edges, by_way, key="name")


def test_cache_reads_both_spellings(spark):
    docs = spark.createDataFrame(
        [("1", None, "2", None, None, "[1, 2]"), (None, 3, None, 4, [3, 4], None)],
        "node1 string, x long, node2 string, y long, path array<long>, path_text string",
    )
    assert pairs(cache.read_paths(docs), "node1", "node2", "path") == [(1, 2, [1, 2]), (3, 4, [3, 4])]
    text = spark.createDataFrame([(5, 6, "[5,6]")], "x long, y long, path string")
    assert pairs(cache.read_paths(text), "node1", "node2", "path") == [(5, 6, [5, 6])]


def test_cache_lookups(spark):
    stored = spark.createDataFrame(
        [(1, 2, 9, 2, [1, 5, 2]), (1, 2, 4, 1, [1, 2]), (3, 4, 1, 1, [3, 4])],
        "node1 long, node2 long, cost_c long, hops int, path array<long>",
    )
    asked = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (2, 1)], "node1 long, node2 long")
    assert pairs(cache.cache_hits(asked, stored), "node1", "node2", "path") == [(1, 2, [1, 2])] * 2
    assert pairs(cache.cache_misses(asked, stored), "node1", "node2") == [(2, 1)]
    assert tuple(cache.cache_stats(stored).first()) == (3, 2, 2)
    assert tuple(cache.cache_stats(stored.limit(0)).first()) == (0, 0, 0)


def test_route_geometry_prefers_the_cheapest_edge(spark):
    schema = "u long, v long, way_id long, cost_c long, road array<struct<lon:double,lat:double>>"
    edges = spark.createDataFrame([
        (1, 2, 7, 5, [(0.0, 0.0), (0.0, 1.0)]), (1, 2, 8, 4, [(9.0, 0.0), (9.0, 1.0)]),
        (2, 3, 7, 5, [(0.0, 1.0), (0.0, 2.0)]),
    ], schema)
    paths = spark.createDataFrame([("p", [1, 2, 3, 4]), ("q", [4, 5])], "path_id string, path array<long>")
    got = {r.path_id: (r.steps, r.line) for r in route_geometry(paths, edges).collect()}
    assert got["p"] == (2, [[0.0, 9.0], [1.0, 9.0], [1.0, 0.0], [2.0, 0.0]])
    assert got["q"] == (0, [])
