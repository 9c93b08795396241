import json

from pyspark.sql import functions as F

from waymesh.operators.graph import Box
from waymesh.plans.network import drivable_network, first_version_tables, routing_edges
from waymesh.plans.routes import precompute_paths, publish_importance
from waymesh.sources import generate, messages, osm, paths, tables

XML = """<?xml version="1.0"?>
<osm>
 <node id="1" lat="46.0" lon="-117.0"/>
 <node id="2" lat="46.01" lon="-117.0"><tag k="highway" v="crossing"/></node>
 <node id="3" lat="46.02" lon="-117.0"/>
 <node id="4" lat="46.02" lon="-117.01"/>
 <node id="10031003387" lat="50.0" lon="-100.0"/>
 <way id="100"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="primary"/><tag k="maxspeed" v="40 mph"/><tag k="name" v="Main"/></way>
 <way id="101"><nd ref="3"/><nd ref="4"/><tag k="highway" v="primary"/></way>
 <way id="102"><nd ref="1"/><nd ref="4"/></way>
 <way id="103"><nd ref="4"/><tag k="highway" v="primary"/></way>
 <way id="104"><nd ref="1"/><nd ref="4"/><tag k="highway" v="footway"/></way>
 <way id="105"><nd ref="4"/><nd ref="1"/><tag k="highway" v="tertiary"/><tag k="oneway" v="yes"/></way>
</osm>"""


def extract(spark, tmp_path):
    file = tmp_path / "map.xml"
    file.write_text(XML)
    return osm.read_osm_nodes(spark, str(file)), osm.read_osm_ways(spark, str(file))


def test_osm_xml(spark, tmp_path):
    nodes, ways = extract(spark, tmp_path)
    assert sorted((r.id, r.lat) for r in nodes.collect())[-1] == (10031003387, 50.0)
    assert nodes.filter("tags['highway'] = 'crossing'").first().id == 2  # an element with a single tag keeps it
    got = {r.way_id: (r.nd, r.tags) for r in ways.collect()}
    assert got[100] == ([1, 2, 3], {"highway": "primary", "maxspeed": "40 mph", "name": "Main"})
    assert got[102] == ([1, 4], {})
    assert got[103] == ([4], {"highway": "primary"})


def test_network_from_extract(spark, tmp_path):
    nodes, ways = extract(spark, tmp_path)
    kept, edges = drivable_network(ways, nodes)
    got = {(r.u, r.v, r.speed, round(r.length_m)) for r in edges.filter("speed IS NOT NULL").collect()}
    # the class mean fills way 101; nothing is known about the tertiary road: it stays, without a cost
    assert got == {(1, 2, 40, 1112), (2, 3, 40, 1112), (3, 4, 40, 772)}
    assert [(r.u, r.v, r.cost_c) for r in edges.filter("speed IS NULL").collect()] == [(4, 1, None)]
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3, 4]
    assert routing_edges(edges).count() == 6
    _, boxed = drivable_network(ways, nodes, Box(46.005, -118.0, 47.0, -116.0))
    assert sorted((r.u, r.v) for r in boxed.collect()) == [(2, 3), (3, 4)]  # node 1 lies south of the box
    n1, e1 = first_version_tables(ways, nodes)
    rows = {(r.x, r.y): r for r in e1.collect()}
    assert set(rows) == {(1, 2), (2, 3), (3, 4), (4, 1)}  # footway has no default speed: zero cost
    assert abs(rows[1, 2].weighted_dist - 40 * 1111.95 / 1609.344) < 0.01
    assert rows[4, 1].oneway == "yes"
    assert sorted(r.osmid for r in n1.collect()) == [1, 2, 3, 4]


def test_csv_versions(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 46.5, -117.0), (2, 46.6, -117.1)], "osmid long, y double, x double")
    tables.write_csv(nodes, str(tmp_path / "nodes.csv"))
    assert sorted(map(tuple, tables.read_nodes_csv(spark, str(tmp_path / "nodes.csv")).collect())) == [(1, 46.5, -117.0), (2, 46.6, -117.1)]
    edges = spark.createDataFrame(
        [(1, 2, True, 12.34, [(-117.0, 46.5), (-117.1, 46.6)])],
        "u long, v long, oneway boolean, weighted_distance double, road array<struct<lon:double,lat:double>>",
    )
    tables.write_csv(edges, str(tmp_path / "edges.csv"))
    back = tables.read_edges_csv(spark, str(tmp_path / "edges.csv")).first()
    assert (back.u, back.v, back.cost_c, [(p.lon, p.lat) for p in back.road]) == (1, 2, 1234, [(-117.0, 46.5), (-117.1, 46.6)])
    (tmp_path / "old.csv").write_text(
        ',u,v,oneway,weighted_distance,road\n0,1,2,False,0.001,"[(-117.0, 46.5), (-117.1, 46.6)]"\n1,x,2,False,oops,\n'
    )
    rows = tables.read_edges_csv(spark, str(tmp_path / "old.csv")).collect()
    assert [(r.u, r.cost_c, r.road and len(r.road)) for r in rows] == [(1, 1, 2), (None, None, None)]
    (tmp_path / "v1.csv").write_text("osmid,lat,lon\n1,46.5,-117\n1,46.5,-117\n2,bad,-117\n")
    assert tables.load_nodes(spark, str(tmp_path / "v1.csv")).count() == 2
    first = tables.read_nodes_csv(spark, str(tmp_path / "v1.csv"), version=1).filter("id = 1").limit(1)
    assert tables.load_nodes(spark, str(tmp_path / "v1.csv"), first).count() == 2
    (tmp_path / "e1.csv").write_text("osmid_x,x,y,name,weighted_dist,oneway,highway\n7,1,2,Main,3.5,yes,primary\n")
    assert tuple(tables.read_edges_csv(spark, str(tmp_path / "e1.csv"), 1).first()) == (1, 2, 7, "Main", "primary", "yes", 3.5)


def test_stored_tables(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 46.5, -117.0), (2, 46.6, -117.1)], "id long, lat double, lon double")
    tables.save_nodes(nodes, str(tmp_path / "n"))
    tables.save_nodes(nodes, str(tmp_path / "n"), mode="append")
    assert spark.read.parquet(str(tmp_path / "n")).count() == 4
    tables.save_nodes(nodes, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 5)], "u long, v long, cost_c long")
    tables.save_edges(edges, nodes, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 1


def test_path_export(spark, tmp_path):
    rows = [(1, 10031003387, [1, 5, 10031003387]), (2, 1, [2, 1])]
    df = spark.createDataFrame(rows, "node1 long, node2 long, path array<long>")
    paths.write_path_export(df, str(tmp_path / "export"))
    back = paths.read_path_export(spark, str(tmp_path / "export"))
    assert sorted((r.node1, r.node2, r.path) for r in back.collect()) == rows
    assert all(len(r.path_id) == 32 for r in back.collect())
    whole = {"a" * 32: {"x": 1, "y": 2, "path": [1, 2]}, "b" * 32: {"x": 2, "y": 3, "path": [2, 3]}}
    (tmp_path / "paths.json").write_text(json.dumps(whole, indent=1))
    got = paths.read_path_export(spark, str(tmp_path / "paths.json"), whole_files=True)
    assert sorted((r.path_id, r.node1, r.path) for r in got.collect()) == [("a" * 32, 1, [1, 2]), ("b" * 32, 2, [2, 3])]


def test_path_log(spark, tmp_path):
    (tmp_path / "paths.txt").write_text(
        "{_id: 5, node1: 11, node2: 12, path: [11, 7, 12]}\nbroken line\n{_id: 6, node1: 12, node2: 11, path: [12, 11]}\n"
    )
    got = paths.read_path_log(spark, str(tmp_path / "paths.txt")).collect()
    assert sorted((r.node1, r.node2, r.path) for r in got) == [(11, 12, [11, 7, 12]), (12, 11, [12, 11])]


def test_cache_appends_each_pair_once(spark, tmp_path):
    where = str(tmp_path / "cache")
    assert paths.open_cache(spark, where).count() == 0
    new = spark.createDataFrame([(1, 2, 7, 1, [1, 2]), (1, 2, 9, 2, [1, 3, 2])], paths.CACHE_SCHEMA)
    paths.append_paths(new, where)
    paths.append_paths(new, where)
    assert [tuple(r) for r in paths.open_cache(spark, where).collect()] == [(1, 2, 7, 1, [1, 2])]


def test_precomputed_paths_feed_importance(spark, tmp_path):
    where = str(tmp_path / "cache")
    edges = spark.createDataFrame(
        [(i, j, 1) for i in range(6) for j in (i - 1, i + 1) if 0 <= j < 6], "u long, v long, cost_c long"
    )
    answers = precompute_paths(spark.range(6), edges, where, 4)
    assert answers.count() == 12 == paths.open_cache(spark, where).count()
    precompute_paths(spark.range(6), edges, where, 4)
    cache = paths.open_cache(spark, where)
    assert cache.count() == 12
    published = publish_importance(edges, cache)
    hops = cache.agg(F.sum("hops")).first()[0]
    assert published.count() == 10
    assert abs(published.agg(F.sum("centrality")).first()[0] - hops / 12) < 1e-9


def test_random_values(spark):
    a = generate.random_values(spark, 1000, 3)
    assert a.count() == 1000
    assert a.filter("value < 0 or value >= 1").count() == 0
    assert [r.value for r in a.orderBy("value").collect()] == [r.value for r in generate.random_values(spark, 1000, 3).repartition(3).orderBy("value").collect()]
    assert 0.4 < a.agg(F.avg("value")).first()[0] < 0.6


def test_publish_misses(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2)], "node1 long, node2 long")
    messages.publish_misses(pairs, "text", path=str(tmp_path / "topic"))
    messages.publish_misses(pairs, "text", path=str(tmp_path / "topic"))
    assert [r.value for r in spark.read.text(str(tmp_path / "topic")).collect()] == ['{"node1":1,"node2":2}'] * 2


def test_a_road_without_speed_joins_two_parts(spark):
    ways = spark.createDataFrame(
        [(1, [1, 2], {"highway": "primary", "maxspeed": "40 mph"}), (2, [2, 3], {"highway": "tertiary"}),
         (3, [3, 4], {"highway": "primary", "maxspeed": "30 mph"})],
        "way_id long, nd array<long>, tags map<string,string>",
    )
    nodes = spark.createDataFrame([(i, 46.0 + i / 100, -117.0) for i in range(1, 5)], "id long, lat double, lon double")
    kept, edges = drivable_network(ways, nodes)
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3, 4]
    assert sorted((r.u, r.v, r.cost_c is None) for r in edges.collect()) == [(1, 2, False), (2, 3, True), (3, 4, False)]


def test_simplified_network(spark):
    from waymesh.plans.network import simplified_network

    tags = {"highway": "primary", "maxspeed": "40 mph;50 mph", "name": "Main"}
    ways = spark.createDataFrame(
        [(1, [1, 2, 3], tags), (2, [3, 4], {"highway": "tertiary", "maxspeed": "30 mph"}), (3, [4, 5], {"highway": "footway"}),
         (4, [3, 6, 7, 8], {"highway": "primary", "oneway": "yes", "name": "Side"}), (5, [8, 3], {"highway": "primary", "oneway": "yes"})],
        "way_id long, nd array<long>, tags map<string,string>",
    )
    nodes = spark.createDataFrame([(i, 46.0 + i / 100, -117.0) for i in range(1, 9)], "id long, lat double, lon double")
    kept, roads = simplified_network(ways, nodes)
    got = {(r.u, r.v): r for r in roads.collect()}
    # 3 is the only junction: the one-way ring 3>6>7>8>3 keeps its pieces up to there
    assert set(got) == {(1, 3), (3, 1), (3, 4), (4, 3), (3, 3)}
    assert got[1, 3].speed == 45 and got[1, 3].pieces == 2 and got[3, 3].speed == 45 and got[3, 4].speed == 30
    assert got[3, 3].way_ids == [4, 5] and got[3, 3].names == ["Side"] and got[3, 3].oneway
    assert [round(p.lat, 2) for p in got[3, 3].road] == [46.03, 46.06, 46.07, 46.08, 46.03]
    assert [round(p.lat, 2) for p in got[3, 1].road] == [46.03, 46.02, 46.01]
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]
