"""Nearest node for a whole table of points, exact for any density of the nodes.

The nodes are filed in cells of 16 degrees, 4 degrees, 1 degree and so on. A cell with
few nodes keeps them as an array; a fuller one lists its (at most 16) non-empty cells of
the next size. A point starts with the cells of the coarsest size and goes
down: per size one equi-join on the cell, then every cell that cannot hold the nearest
node is dropped, because its smallest possible distance exceeds the largest possible
distance of another cell. No point meets more than a handful of cells, however many
nodes or points share one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.geo import chord_to_metres, half_chord
from waymesh.operators.cleaning import located
from waymesh.runtime import store, task_count

FAN_OUT = 4
COARSEST = 16.0
FINEST_LEVEL = 12  # 16 / 4**12 degrees are about 10 cm
NODES_PER_CELL = 64


def _size(level: int) -> float:
    return COARSEST / FAN_OUT**level


def _cell(level: int) -> dict[str, Column]:
    size = _size(level)
    return {
        "cx": F.floor((F.col("lon") + 180.0) / size).cast("bigint"),
        "cy": F.floor((F.col("lat") + 90.0) / size).cast("bigint"),
    }


def _bounds(level: int) -> str:
    """SQL for a cell ``c`` with its smallest and largest half chord to ``(lat, lon)``."""
    size = _size(level)
    half = size / 2
    mid_lat = f"(c.cy * {size!r}D - 90.0D + {half!r}D)"
    dlat = f"abs(lat - {mid_lat})"
    dlon = f"abs(pmod(lon - (c.cx * {size!r}D - 180.0D + {half!r}D) + 180.0D, 360.0D) - 180.0D)"
    least_cos = f"cos(radians(least(90.0D, abs({mid_lat}) + {half!r}D)))"
    most_cos = f"cos(radians(greatest(0.0D, abs({mid_lat}) - {half!r}D)))"

    def chord(a: str, b: str, other_cos: str) -> str:
        return f"power(sin(radians({a}) / 2), 2) + cos(radians(lat)) * {other_cos} * power(sin(radians({b}) / 2), 2)"

    near = chord(f"greatest(0.0D, {dlat} - {half!r}D)", f"greatest(0.0D, {dlon} - {half!r}D)", least_cos)
    far = chord(f"least(180.0D, {dlat} + {half!r}D)", f"least(180.0D, {dlon} + {half!r}D)", most_cos)
    return f"named_struct('near', {near}, 'far', {far}, 'cx', c.cx, 'cy', c.cy)"


_SLACK = "* (1 + 1e-9D) + 1e-18D"  # rounding must never drop the right cell


@dataclass(frozen=True)
class NodeIndex:
    """``levels[i]`` is a table ``cx, cy, nodes, cells``; ``top`` one row with the coarsest cells."""

    top: DataFrame
    levels: list[DataFrame]


def index_nodes(nodes: DataFrame, per_cell: int = NODES_PER_CELL) -> NodeIndex:
    """File the nodes; only cells with more than ``per_cell`` nodes are divided further."""
    # of several nodes at one place the smallest id answers
    left = store(located(nodes).groupBy("lat", "lon").agg(F.min("id").alias("id"))).df
    leaves: list[DataFrame] = []
    for level in range(1, FINEST_LEVEL + 1):
        placed = left.withColumns(_cell(level))
        counts = store(
            placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")),
            full=F.count_if(F.col("n") > per_cell),
        )
        last = level == FINEST_LEVEL or not counts.stats["full"]
        roomy = counts.df if last else counts.df.filter(F.col("n") <= per_cell)
        leaves.append(
            placed.join(roomy.select("cx", "cy"), ["cx", "cy"], "left_semi")
            .groupBy("cx", "cy")
            .agg(F.collect_list(F.struct("id", "lat", "lon")).alias("nodes"))
        )
        if last:
            break
        full = counts.df.filter(F.col("n") > per_cell).select("cx", "cy")
        left = placed.join(full, ["cx", "cy"], "left_semi").select("lat", "lon", "id")

    levels: list[DataFrame] = []
    for leaf in reversed(leaves):
        here = leaf.withColumn("cells", F.lit(None).cast("array<struct<cx:bigint,cy:bigint>>"))
        if levels:
            here = here.unionByName(_divided(levels[0], leaf.schema["nodes"].dataType))
        levels.insert(0, store(here).df)
    # at most 276 rows: the world has no more cells of 16 degrees
    coarse = F.broadcast(_divided(levels[0], leaves[0].schema["nodes"].dataType))
    top = coarse.agg(F.collect_list(F.struct("cx", "cy")).alias("cells"))
    return NodeIndex(top, [coarse, *levels])


def _divided(below: DataFrame, nodes_type) -> DataFrame:
    """The cells one size up, each with the list of its non-empty parts."""
    parent = F.floor(F.col("cx") / FAN_OUT).alias("px"), F.floor(F.col("cy") / FAN_OUT).alias("py")
    return below.groupBy(*parent).agg(F.collect_list(F.struct("cx", "cy")).alias("cells")).select(
        F.col("px").alias("cx"), F.col("py").alias("cy"), F.lit(None).cast(nodes_type).alias("nodes"), "cells"
    )


def _expand(rows: DataFrame, level: int, bound: str) -> DataFrame:
    """Add ``open``: the members of ``cells`` that may hold something at most ``bound`` away."""
    measured = rows.withColumn("measured", F.expr(f"transform(cells, c -> {_bounds(level)})"))
    limited = measured.withColumn("bound", F.expr(f"least({bound}, array_min(transform(measured, c -> c.far)))"))
    return limited.withColumn("open", F.expr(f"filter(measured, c -> c.near <= bound {_SLACK})")).drop("measured")


def nearest_node(
    points: DataFrame, nodes: DataFrame | NodeIndex, lat: str = "lat", lon: str = "lon",
    node: str = "node", distance: str | None = "dist_m",
) -> DataFrame:
    """Add the id of the nearest node (ties: smallest id) and its distance in metres.

    Points at the same place are searched once, and points without coordinates drop out.
    """
    index = nodes if isinstance(nodes, NodeIndex) else index_nodes(nodes)
    tasks = task_count(points.sparkSession)
    spots = points.select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).dropna().distinct()
    # a whole number as key: floating-point keys are normalised and shuffled anew by each window
    spots = store(spots.withColumn("spot", F.monotonically_increasing_id())).df
    beam = ["spot", "lat", "lon", "bound"]

    def opened(rows: DataFrame) -> DataFrame:
        # the outer form keeps the planner from copying the bounds into an early filter
        return rows.select(*beam, F.explode_outer("open").alias("c"))

    todo = _expand(spots.repartition(tasks, "spot").withColumn("cells", index.top.scalar()), 0, "2.0D")
    todo = opened(todo).select(*beam, "c.cx", "c.cy")

    answers: list[DataFrame] = []
    for level, table in enumerate(index.levels):
        met = todo.join(table, ["cx", "cy"])
        chord = (
            "power(sin(radians(n.lat - lat) / 2), 2) + "
            "cos(radians(lat)) * cos(radians(n.lat)) * power(sin(radians(n.lon - lon) / 2), 2)"
        )
        met = met.withColumn("best", F.expr(f"array_min(transform(nodes, n -> named_struct('h', {chord}, 'id', n.id)))"))
        step = store(
            _expand(met, level + 1, "bound, best.h").select(*beam, "best", "open"),
            more=F.count_if(F.coalesce(F.size("open"), F.lit(0)) > 0),
        )
        answers.append(step.df.filter(F.col("best").isNotNull()).select("spot", "best"))
        if not step.stats["more"]:
            break
        # the beam of a point is a few rows: share its tightest bound among them
        shared = F.min("bound").over(Window.partitionBy("spot"))
        todo = (
            opened(step.df.filter(F.size("open") > 0).repartition(tasks, "spot").withColumn("bound", shared))
            .filter(f"c.near <= bound {_SLACK}")
            .select(*beam, "c.cx", "c.cy")
        )
    found = reduce(DataFrame.unionByName, answers).groupBy("spot").agg(F.min("best").alias("best")).join(spots, "spot")
    found = found.select(
        F.col("lat").alias(lat), F.col("lon").alias(lon), F.col("best.id").alias(node),
        *([chord_to_metres(F.col("best.h")).alias(distance)] if distance else []),
    )
    return points.join(found, [lat, lon]).select(*points.columns, node, *([distance] if distance else []))


def nearest_to(nodes: DataFrame, lat: float, lon: float) -> DataFrame:
    """One query point: a top-1 over a single scan."""
    h = half_chord(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    return (
        located(nodes).select("id", chord_to_metres(h).alias("dist_m"), h.alias("h"))
        .orderBy("h", "id").limit(1).drop("h")
    )
