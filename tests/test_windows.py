"""Windows over edges stored by place."""

import random

from pyspark.sql import functions as F

from waymesh.functions.geo import morton
from waymesh.operators.graph import Box, bbox_subgraph, edges_in_box
from waymesh.operators.overlay import centrality_in_window
from waymesh.operators.windows import edges_in_window, load_edges_by_place, save_edges_by_place, z_ranges


def test_ranges_hold_the_box_and_little_else(spark):
    rng = random.Random(4)
    points = [(46 + rng.random(), -118 + rng.random()) for _ in range(4000)] + [(-90.0, -180.0), (90.0, 180.0), (46.25, -117.75), (46.5, -117.5)]
    df = spark.createDataFrame(points, "lat double, lon double").withColumn("z", morton("lat", "lon"))
    keyed = [tuple(r) for r in df.collect()]
    for box in (Box(46.25, -117.75, 46.5, -117.5), Box(46.1, -118.0, 46.11, -117.0), Box(46.3, -117.6, 46.3, -117.6), Box(-90.0, -180.0, 90.0, 180.0)):
        for most in (1, 8, 32):
            ranges = z_ranges(box, most)
            assert 1 <= len(ranges) <= most and ranges == sorted(ranges)
            found = [(lat, lon) for lat, lon, z in keyed if any(low <= z <= high for low, high in ranges)]
            held = [(lat, lon) for lat, lon, _ in keyed if box.south <= lat <= box.north and box.west <= lon <= box.east]
            assert set(held) <= set(found)
    square = z_ranges(Box(46.25, -117.75, 46.5, -117.5))
    assert sum(any(low <= z <= high for low, high in square) for _, _, z in keyed) < 2 * 4000 / 16 * 1.5


def city(spark, width=60):
    nodes = [(y * width + x, 46 + y / 100, -118 + x / 100) for y in range(width) for x in range(width)] + [(10**6, None, None)]
    edges = [(i, i + 1, 5 + i % 3, i / 7) for i in range(width * width - 1) if i % width < width - 1]
    edges += [(i, i + width, 4, i / 5) for i in range(width * (width - 1))] + [(0, 10**6, 1, 0.5), (7, 10**7, 1, 0.5)]
    return (spark.createDataFrame(nodes, "id long, lat double, lon double"),
            spark.createDataFrame(edges, "u long, v long, cost_c long, centrality double"))


def rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def scan_rows(df):
    """Rows the file scan of a filter gave out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return int(leaves.apply(0).metrics().get("numOutputRows").get().value())


def test_stored_windows_equal_joined_ones_and_skip_row_groups(spark, tmp_path):
    nodes, edges = city(spark)
    path = str(tmp_path / "edges")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        save_edges_by_place(edges, nodes, path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    placed = load_edges_by_place(spark, path)
    box = Box(46.1, -117.9, 46.2, -117.8)
    assert rows(edges_in_box(nodes, placed, box)) == rows(edges_in_box(nodes, edges, box))
    assert rows(bbox_subgraph(nodes, placed, (46.2, -117.8), (46.1, -117.9))) == rows(bbox_subgraph(nodes, edges, (46.2, -117.8), (46.1, -117.9)))
    assert rows(centrality_in_window(nodes, placed, box)) == rows(centrality_in_window(nodes, edges, box))
    assert edges_in_window(placed, Box(10.0, 10.0, 11.0, 11.0)).count() == 0
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    found = edges_in_window(placed, box)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(z_u" in plan and "Exchange" not in plan
    assert scan_rows(found) < placed.count() / 3  # whole row groups were never read
    assert placed.filter(F.col("z_u").isNull()).count() == 0
