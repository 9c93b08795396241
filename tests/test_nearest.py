import math
import random

import pytest

from waymesh.operators.nearest import index_nodes, nearest_node, nearest_to


def half_chord(a, b):
    s = math.sin(math.radians(b[0] - a[0]) / 2)
    t = math.sin(math.radians(b[1] - a[1]) / 2)
    return s * s + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * t * t


def check(spark, nodes, points, per_cell=8):
    ndf = spark.createDataFrame([(i, *n) for i, n in enumerate(nodes)], "id long, lat double, lon double")
    pdf = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "k long, lat double, lon double")
    got = {r.k: r.node for r in nearest_node(pdf, index_nodes(ndf, per_cell)).collect()}
    for i, p in enumerate(points):
        assert got[i] == min(range(len(nodes)), key=lambda j: (half_chord(p, nodes[j]), j)), (p, nodes[got[i]])


def test_uneven_density(spark):
    rng = random.Random(3)
    town = [(46.73 + rng.gauss(0, 0.01), -117.18 + rng.gauss(0, 0.01)) for _ in range(500)]
    land = [(rng.uniform(30, 60), rng.uniform(-130, -60)) for _ in range(100)]
    points = [(rng.uniform(25, 65), rng.uniform(-140, -50)) for _ in range(60)]
    points += [(46.73 + rng.gauss(0, 0.02), -117.18 + rng.gauss(0, 0.02)) for _ in range(60)]
    check(spark, town + land, points)


def test_around_the_world(spark):
    rng = random.Random(9)
    nodes = [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(150)] + [(10.0, 179.9), (-10.0, -179.9)]
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(10.0, -179.95), (90.0, 0.0), (-90.0, 5.0)]
    check(spark, nodes, points)


def test_far_more_nodes_in_one_place_than_fit_a_cell(spark):
    rng = random.Random(4)
    nodes = [(46.7 + rng.random() * 1e-6, -117.2 + rng.random() * 1e-6) for _ in range(120)] + [(46.7, -117.2)] * 5
    check(spark, nodes, [(46.7, -117.2), (46.7000005, -117.1999995), (47.0, -117.0)])


def test_single_node_ties_and_missing_coordinates(spark):
    ndf = spark.createDataFrame([(5, 1.0, 1.0), (3, 1.0, 1.0), (9, None, 2.0)], "id long, lat double, lon double")
    pdf = spark.createDataFrame([(1, -40.0, 100.0), (2, None, 1.0)], "k long, lat double, lon double")
    got = nearest_node(pdf, ndf).collect()
    assert [(r.k, r.node) for r in got] == [(1, 3)]
    assert nearest_to(ndf, 1.0, 1.1).first().id == 3
    assert got[0].dist_m == pytest.approx(2 * 6371008.8 * math.asin(math.sqrt(half_chord((-40.0, 100.0), (1.0, 1.0)))))
