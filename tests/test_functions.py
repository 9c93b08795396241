import math

import pytest
from pyspark.sql import functions as F

from waymesh.functions import (
    default_speed, edge_label, first_class, geo_distance, is_oneway, iterate_map, iterate_map_pandas, line_text, morton,
    parse_id_list, parse_linestring, parse_speed, project_tags, road_from_text, road_latlon, split_label, tag_map,
    travel_cost, weighted_dist,
)


def one(spark, column, **values):
    df = spark.range(1).select(*[v.alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [
    (["25 mph"], 25), (["25"], 25), (["25 mph", "36 mph"], 30), (["25 mph", "30 mph"], 27), (["signals"], None),
    (["25 mph", "none"], None), (["0"], None), ([" 40  mph "], 40), (["25.5 mph"], None), ([], None), (None, None), ([""], None),
    (["10", "0"], 5), (["0", "0"], None), (["-3", "2"], None),
])
def test_parse_speed(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "m array<string>")
    assert df.select(parse_speed("m").alias("x")).first().x == want


def test_first_class(spark):
    df = spark.createDataFrame([(["primary", "trunk"],), ([],), (None,)], "h array<string>")
    assert [r.x for r in df.select(first_class("h").alias("x")).collect()] == ["primary", None, None]


@pytest.mark.parametrize("highway, posted, want", [
    ("primary", "35 mph", 35.0), ("primary", "35", 35.0), ("primary", "35.5 mph", 35.5), ("primary", None, 60.0),
    ("tertiary", None, 30.0), ("service", "signals", 20.0), ("unclassified", None, 0.0), (None, None, 0.0),
])
def test_default_speed(spark, highway, posted, want):
    df = spark.createDataFrame([(highway, posted)], "h string, m string")
    assert df.select(default_speed("h", "m").alias("x")).first().x == want


@pytest.mark.parametrize("length, speed, want", [
    (100.0, 25, 400), (0.01, 90, 1), (123.456, 30, 412), (10.0, None, None), (10.0, 0, None), (None, 30, None),
])
def test_travel_cost(spark, length, speed, want):
    df = spark.createDataFrame([(length, speed)], "l double, s int")
    assert df.select(travel_cost("l", "s").alias("x")).first().x == want


def test_weighted_dist_treats_missing_as_zero(spark):
    df = spark.createDataFrame([(20.0, 1.5), (None, 1.5), (20.0, None)], "s double, d double")
    assert [r.x for r in df.select(weighted_dist("s", "d").alias("x")).collect()] == [30.0, 0.0, 0.0]


def test_oneway_spellings(spark):
    df = spark.createDataFrame([("Yes",), ("yes",), ("True",), ("1",), ("no",), (None,)], "o string")
    assert [r.x for r in df.select(is_oneway("o").alias("x")).collect()] == [True, True, True, True, False, False]
    assert one(spark, is_oneway(F.lit(True))) is True


def test_distance_on_the_sphere(spark):
    def d(a, b, c, e):
        p, q = math.radians(a), math.radians(c)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(e - b) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    got = one(spark, geo_distance(46.7, -117.2, 47.6, -122.3))
    assert got == pytest.approx(d(46.7, -117.2, 47.6, -122.3), rel=1e-12)
    assert one(spark, geo_distance(46.7, -117.2, 47.6, -122.3, "mi")) == pytest.approx(got / 1609.344)
    assert one(spark, geo_distance(0.0, 0.0, 0.0, 180.0)) == pytest.approx(math.pi * 6371008.8)
    with pytest.raises(ValueError):
        geo_distance(0.0, 0.0, 0.0, 1.0, "km")


def test_lines(spark):
    assert one(spark, line_text(46.5, -117.0, 46.25, -117.5)) == "46.5 -117.0, 46.25 -117.5"
    road = one(spark, parse_linestring(F.lit("LINESTRING (-117.18 46.73, -117 46.7, 1e-3 -4.5E1)")))
    assert [(p.lon, p.lat) for p in road] == [(-117.18, 46.73), (-117.0, 46.7), (0.001, -45.0)]
    text = one(spark, road_from_text(F.lit("[(-117.18, 46.73), (-117.0, 46.7)]")))
    assert [(p.lon, p.lat) for p in text] == [(-117.18, 46.73), (-117.0, 46.7)]
    swapped = one(spark, road_latlon(parse_linestring(F.lit("LINESTRING (-117.18 46.73, -117 46.7)"))))
    assert swapped == [[46.73, -117.18], [46.7, -117.0]]


def test_labels(spark):
    assert one(spark, edge_label(F.lit(10031003387), F.lit(-4))) == "(10031003387,-4)"
    back = one(spark, split_label(F.lit("(10031003387,-4)")))
    assert (back.u, back.v) == (10031003387, -4)


def test_tags(spark):
    df = spark.createDataFrame(
        [([("highway", "primary"), ("name", "A")],), ([("highway", "x"), ("highway", "y")],), ([],), (None,)],
        "tag array<struct<_k:string,_v:string>>",
    ).select(tag_map("tag").alias("tags"))
    got = [(r.highway, r.name) for r in project_tags(df, ["highway", "name"]).collect()]
    assert got == [("primary", "A"), ("y", None), (None, None), (None, None)]


def test_id_lists(spark):
    assert one(spark, parse_id_list(F.lit("[1, 10031003387]"))) == [1, 10031003387]
    assert one(spark, parse_id_list(F.lit("no list"))) is None


def test_iterate_map(spark):
    df = spark.createDataFrame([(0.3,), (1.2,), (0.0,)], "v double")
    rows = df.select("v", iterate_map("v", 100).alias("a"), iterate_map_pandas("v", 100).alias("b")).collect()
    for r in rows:
        want = r.v
        for _ in range(100):
            want = want * want - 0.5
        assert r.a == want == r.b
    assert one(spark, iterate_map(F.lit(0.7), 0)) == 0.7


def test_morton_keeps_quadrants_together(spark):
    def key(lat, lon):
        return one(spark, morton(F.lit(lat), F.lit(lon)))

    assert abs(key(46.70, -117.10) - key(46.71, -117.11)) < abs(key(46.70, -117.10) - key(10.0, 20.0))
    assert key(-90.0, -180.0) == 0
