"""Routes as lines on the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geo import road_latlon
from waymesh.operators.steps import path_steps


def route_geometry(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Ordered list of ``[lat, lon]`` along each path: ``path_id, steps, line``.

    Of parallel edges the cheapest is drawn, then the one of the smallest way id. A
    step without an edge adds nothing. ``steps`` counts the steps that were drawn.
    """
    way = [c for c in ("way_id",) if c in edges.columns]
    used = path_steps(paths)
    # only edges some path uses are worth picking from
    wanted = edges.join(used.select("u", "v").distinct(), ["u", "v"], "left_semi")
    drawn = wanted.groupBy("u", "v").agg(F.min_by("road", F.struct("cost_c", *way)).alias("road"))
    steps = used.join(drawn, ["u", "v"], "left").select("path_id", "pos", road_latlon("road").alias("points"))
    lines = steps.groupBy("path_id").agg(
        F.count("points").alias("steps"),
        F.flatten(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("points").isNotNull(), F.struct("pos", "points")))),
            lambda s: s["points"],
        )).alias("line"),
    )
    return lines
