"""The map overlay: centrality inside a window, its statistics and its colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.operators.graph import Box, edges_in_box
from waymesh.operators.importance import with_centrality
from waymesh.runtime import store


def centrality_in_window(nodes: DataFrame, edges: DataFrame, window: Box) -> DataFrame:
    """Edges with a centrality and both ends inside the window."""
    return edges_in_box(nodes, with_centrality(edges), window)


def window_stats(edges: DataFrame) -> DataFrame:
    """One row: mean, smallest and largest centrality."""
    return edges.agg(
        F.avg("centrality").alias("mean_c"), F.min("centrality").alias("min_c"), F.max("centrality").alias("max_c")
    )


def upper_half_median(df: DataFrame, column: str = "centrality", name: str = "q3") -> DataFrame:
    """One row: the median of the upper half, without the middle value if the count is odd.

    A single value is its own result; no values give NULL. Equal values are counted
    before anything is sorted, and the different values are range-partitioned, so no
    task sees them all: running counts within a part start from the sum of the parts
    before it.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    ranged = store(
        counted.repartitionByRange("x").withColumn("part", F.spark_partition_id()), total=F.sum("n")
    )
    total = ranged.stats["total"] or 0
    half = total // 2
    if total == 1:
        wanted = [0]
    elif half % 2:
        wanted = [total - half + half // 2]
    else:
        wanted = [total - half + half // 2 - 1, total - half + half // 2]
    before = ranged.df.groupBy("part").agg(F.sum("n").alias("size")).select(
        "part",
        F.coalesce(
            F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    running = F.sum("n").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.df.withColumn("upto", running).join(before, "part").select(
        "x", (F.col("before") + F.col("upto") - F.col("n")).alias("lo"), (F.col("before") + F.col("upto")).alias("hi")
    )
    places = F.array(*[F.lit(p).cast("bigint") for p in wanted])
    met = placed.select("x", F.size(F.filter(places, lambda p: (p >= F.col("lo")) & (p < F.col("hi")))).alias("times"))
    return met.filter("times > 0").agg(
        (F.sum(F.col("x") * F.col("times")) / F.sum("times")).alias(name)
    )


def above_q3(edges: DataFrame, q3: DataFrame | None = None) -> DataFrame:
    """Only edges at or above the upper-half median are drawn."""
    q3 = q3 if q3 is not None else upper_half_median(edges)
    return edges.filter(F.col("centrality") >= q3.scalar())


def overlay_colors(edges: DataFrame) -> DataFrame:
    """Add ``color``: NULL below the upper-half median, else ``rgb(r,0,b)`` from blue to red."""
    top = store(edges.agg(F.max("centrality").alias("top"))).df
    q3 = store(upper_half_median(edges)).df
    marked = edges.withColumns({"q3": q3.scalar(), "top": top.scalar()})
    base = F.col("top") - F.col("q3")
    percent = F.when(base == 0, F.lit(100.0)).otherwise((F.col("centrality") - F.col("q3")) / F.nullif(base, F.lit(0.0)) * 100)
    level = F.floor(255 * (F.col("percent") / 100) + 0.5).cast("string")
    color = F.when(
        F.col("centrality") >= F.col("q3"),
        F.when(F.col("percent") > 50, F.concat(F.lit("rgb(255,0,"), level, F.lit(")")))
        .otherwise(F.concat(F.lit("rgb("), level, F.lit(",0,255)"))),
    )
    return marked.withColumn("percent", percent).withColumn("color", color).drop("q3", "top", "percent")
