import random

import pytest

from waymesh.operators.graph import Box
from waymesh.operators.overlay import above_q3, centrality_in_window, overlay_colors, upper_half_median, window_stats


def upper_median(values):
    values = sorted(values)
    n = len(values)
    if n == 1:
        return values[0]
    half = values[n - n // 2:]
    m = len(half)
    return half[m // 2] if m % 2 else (half[m // 2 - 1] + half[m // 2]) / 2


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0, 5.0], [2.0] * 7, [5.0, 5.0, 1.0, 1.0, 1.0, 9.0],
])
def test_upper_half_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "centrality double")
    assert upper_half_median(df).first().q3 == upper_median(values)


def test_upper_half_median_with_a_dominant_value(spark):
    rng = random.Random(1)
    values = [0.5] * 400 + [rng.random() for _ in range(777)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "centrality double").repartition(7)
    assert upper_half_median(df).first().q3 == upper_median(values)


def test_no_values(spark):
    df = spark.createDataFrame([], "centrality double")
    assert upper_half_median(df).first().q3 is None
    assert overlay_colors(df).count() == 0
    assert tuple(window_stats(df).first()) == (None, None, None)


def color(c, q3, top):
    if c < q3:
        return None
    p = 100 if top == q3 else (c - q3) / (top - q3) * 100
    level = int(255 * (p / 100) + 0.5)
    return f"rgb(255,0,{level})" if p > 50 else f"rgb({level},0,255)"


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], [4.0, 4.0, 4.0], [1.0]])
def test_colors(spark, values):
    df = spark.createDataFrame([(float(i), v) for i, v in enumerate(values)], "k double, centrality double")
    q3, top = upper_median(values), max(values)
    got = {r.k: r.color for r in overlay_colors(df).collect()}
    assert got == {float(i): color(v, q3, top) for i, v in enumerate(values)}
    assert above_q3(df).count() == sum(v >= q3 for v in values)


def test_window_needs_both_ends_and_a_value(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 5.0, 5.0)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2, 0.3), (2, 1, None), (2, 3, 0.9)], "u long, v long, centrality double")
    got = centrality_in_window(nodes, edges, Box(0, 0, 1, 1)).collect()
    assert [(r.u, r.v, r.centrality) for r in got] == [(1, 2, 0.3)]
