import math
import random

import pytest

from waymesh.operators.components import component_sizes, connected_components, keep_largest, largest_component
from waymesh.operators.shaping import chain_nodes, close_links, consolidate, simplify_chains


def find_components(nodes, edges):
    root = {n: n for n in nodes}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for u, v in edges:
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(7)
    nodes = list(range(120))
    edges = {
        "chain": [(i, i + 1) for i in range(99)] + [(110, 105)],
        "star": [(0, i) for i in range(1, 80)] + [(90, i) for i in range(91, 100)],
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(70)],
        "none": [(5, 5)],
    }[shape]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.id: r.component for r in connected_components(df, spark.createDataFrame([(n,) for n in nodes], "id long")).collect()}
    assert got == find_components(nodes, edges)


def test_component_of_other_key_types(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "u string, v string")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_largest_component(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (20, 21)], "u long, v long")
    labels = connected_components(edges)
    assert sorted((r.component, r["size"]) for r in component_sizes(labels).collect()) == [(1, 3), (10, 3), (20, 2)]
    assert sorted(r.id for r in largest_component(labels).collect()) == [1, 2, 3]
    nodes, kept = keep_largest(spark.createDataFrame([(i,) for i in (1, 2, 3, 10, 99)], "id long"), edges)
    assert sorted(r.id for r in nodes.collect()) == [1, 2, 3]
    assert kept.count() == 2


def metres(a, b):
    s = math.sin(math.radians(b[0] - a[0]) / 2)
    t = math.sin(math.radians(b[1] - a[1]) / 2)
    return 2 * 6371008.8 * math.asin(math.sqrt(s * s + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * t * t))


@pytest.mark.parametrize("spread", [0.002, 0.01])
def test_consolidate(spark, spread):
    rng = random.Random(11)
    places = [(46.7 + rng.uniform(-spread, spread), -117.2 + rng.uniform(-spread, spread)) for _ in range(90)] + [(46.7, -117.2)] * 3
    ids = list(range(len(places)))
    links = [(i, j) for i in ids for j in ids if i < j and metres(places[i], places[j]) <= 40]
    want = find_components(ids, links)
    edges = [(i, (i * 7 + 3) % len(ids), 5 + i % 4) for i in ids]
    ndf = spark.createDataFrame([(i, *places[i]) for i in ids], "id long, lat double, lon double")
    nodes, rewired = consolidate(ndf, spark.createDataFrame(edges, "u long, v long, cost_c long"), tol_m=20)
    got = {r.id: (r.lat, r.lon, r.merged) for r in nodes.collect()}
    assert set(got) == set(want.values())
    for label, (lat, lon, merged) in got.items():
        members = [places[i] for i in ids if want[i] == label]
        assert merged == len(members)
        assert (lat, lon) == pytest.approx((sum(p[0] for p in members) / merged, sum(p[1] for p in members) / merged))
    cheapest = {}
    for u, v, c in edges:
        key = (want[u], want[v])
        if key[0] != key[1]:
            cheapest[key] = min(c, cheapest.get(key, c))
    assert {(r.u, r.v): r.cost_c for r in rewired.collect()} == cheapest


def test_simplify_chains(spark):
    # 1-2-3-4 two-way with junctions at the ends, a one-way chain 4>5>6>1, a ring 20-21-22
    two_way = [(1, 2), (2, 3), (3, 4), (4, 8), (1, 9), (20, 21), (21, 22), (22, 20)]
    edges = [(a, b) for p in two_way for a, b in (p, p[::-1])] + [(4, 5), (5, 6), (6, 1)]
    df = spark.createDataFrame(
        [(u, v, 10.0 * u, u + v, "r" if u < v else "s", "25" if u % 2 else "30") for u, v in edges],
        "u long, v long, length_m double, cost_c long, highway string, maxspeed string",
    )
    assert sorted(r.id for r in chain_nodes(df).collect()) == [2, 3, 5, 6, 20, 21, 22]
    got = {(r.u, r.v, r.pieces, r.cost_c, tuple(r.highway), tuple(r.maxspeed)) for r in simplify_chains(df).collect()}
    assert got == {
        (1, 4, 3, 15, ("r",), ("25", "30")), (4, 1, 3, 15, ("s",), ("25", "30")),
        (4, 1, 3, 27, ("r", "s"), ("25", "30")),
        (4, 8, 1, 12, ("r",), ("30",)), (8, 4, 1, 12, ("s",), ("30",)),
        (1, 9, 1, 10, ("r",), ("25",)), (9, 1, 1, 10, ("s",), ("25",)),
        (20, 20, 3, 126, ("r", "s"), ("25", "30")),
    }


@pytest.mark.parametrize("per_join", [4096, 12])
def test_crowded_places_are_divided(spark, monkeypatch, per_join):
    monkeypatch.setattr("waymesh.operators.shaping.PAIRS_PER_JOIN", per_join)
    # two crowds of 90 nodes whose distance is close to the reach: only some pairs are near enough
    rng = random.Random(3)
    one = [(46.7 + rng.uniform(0, 4e-5), -117.2 + rng.uniform(0, 4e-5)) for _ in range(90)]
    two = [(46.7 + 3.6e-4 + rng.uniform(0, 4e-5), -117.2 + rng.uniform(0, 4e-5)) for _ in range(90)]
    for reach in (35.3, 36.5, 40.0):
        places = one + two
        want = find_components(range(180), [
            (i, j) for i in range(180) for j in range(i) if metres(places[i], places[j]) <= reach
        ])
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, lat double, lon double")
        links = [(r.u, r.v) for r in close_links(df, reach).collect()]
        assert find_components(range(180), links) == want
        assert len(links) < 400


def test_close_nodes_at_the_antimeridian_and_near_a_pole(spark):
    nodes = [(1, 10.0, 179.99995), (2, 10.0, -179.99995), (3, 89.9, 10.0), (4, 89.9, 10.05), (5, 89.9, 190.0), (6, 10.0, 0.0)]
    ndf = spark.createDataFrame(nodes, "id long, lat double, lon double")
    merged, _ = consolidate(ndf, spark.createDataFrame([(1, 6, 5)], "u long, v long, cost_c long"), tol_m=10)
    got = {r.id: (round(r.lat, 6), round(abs(r.lon), 6), r.merged) for r in merged.collect()}
    assert got == {1: (10.0, 180.0, 2), 3: (89.9, 10.025, 2), 5: (89.9, 190.0, 1), 6: (10.0, 0.0, 1)}


def test_chains_are_drawn_in_order(spark):
    # a long two-way road 1..40 of three ways, a one-way road 40>50>51>1, a ring 60-61-62, parallel ways between 70 and 71
    def point(i):
        return (float(i), 46.0 + i / 100)

    def piece(u, v, way, name, speeds, bend=None):
        road = [point(u), *([bend] if bend else []), point(v)]
        return (u, v, float(u + v), [f"class{way % 2}"], speeds, way, name, road)

    two_way = [piece(i, i + 1, 100 + i // 14, f"Road {i // 20}" if i % 9 else None, ["25 mph"] if i % 2 else None) for i in range(1, 40)]
    two_way += [piece(1, 90, 200, "A", None), piece(40, 91, 201, "B", None), piece(70, 71, 300, "C", None), piece(71, 70, 301, "D", None), piece(71, 72, 302, None, None)]
    two_way += [piece(60, 61, 400, "R", None, bend=(7.5, 7.5)), piece(61, 62, 400, "R", None), piece(62, 60, 401, "R", None)]
    one_way = [piece(40, 50, 500, "O", None), piece(50, 51, 501, "O", None), piece(51, 1, 501, "P", None)]
    back = [(v, u, n, h, m, w, name, road[::-1]) for u, v, n, h, m, w, name, road in two_way]
    rows = [(*r, False) for r in two_way + back] + [(*r, True) for r in one_way]
    df = spark.createDataFrame(
        rows, "u long, v long, length_m double, highway array<string>, maxspeed array<string>, way_id long, name string, "
        "road array<struct<lon: double, lat: double>>, oneway boolean",
    )
    got = {(r.u, r.v, tuple(r.way_ids)): r for r in simplify_chains(df).collect()}
    road = got[1, 40, (100, 101, 102)]
    assert [tuple(p) for p in road.road] == [point(i) for i in range(1, 41)]
    assert road.pieces == 39 and road.length_m == sum(2 * i + 1 for i in range(1, 40)) and not road.oneway
    assert (road.highway, road.maxspeed) == (["class0", "class1"], ["25 mph"])
    assert road.names[0] == "Road 0" and set(road.names) == {"Road 0", "Road 1"}
    other = got[40, 1, (102, 101, 100)]
    assert [tuple(p) for p in other.road] == [point(i) for i in range(40, 0, -1)] and other.length_m == road.length_m
    single = got[40, 1, (500, 501)]
    assert single.oneway and single.names == ["O", "P"] and [p.lon for p in single.road] == [40.0, 50.0, 51.0, 1.0]
    # parallel ways make their ends junctions; ways back of both are there too
    assert {k for k in got if set(k[:2]) == {70, 71}} == {(70, 71, (300,)), (70, 71, (301,)), (71, 70, (300,)), (71, 70, (301,))}
    rings = [r for k, r in got.items() if k[:2] == (60, 60)]
    assert len(rings) == 2 and all(r.pieces == 3 and r.road[0] == r.road[-1] and len(r.road) == 5 for r in rings)


def test_no_edges(spark):
    df = spark.createDataFrame([], "u long, v long, length_m double, cost_c long, highway string, maxspeed string")
    assert simplify_chains(df).count() == 0
