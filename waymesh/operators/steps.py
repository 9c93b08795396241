"""Node sequences: numbering, successors and the steps of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.runtime import store


def ordered_steps(visits: DataFrame, keys: list[str], order: list[str], node: str) -> DataFrame:
    """Number the visits of each key and add the following node: ``pos``, ``next_<node>``.

    A plain window would bring all visits of a key into one task. Here the table is
    range-partitioned by key *and* order, so a key of any size spreads over many
    partitions; the windows run inside a part, and one summary row per part links
    each part to the next.
    """
    ranged = store(
        visits.repartitionByRange(*[F.col(c) for c in keys + order]).withColumn("part", F.spark_partition_id())
    ).df
    inside = Window.partitionBy(*keys, "part").orderBy(*order)
    rows = ranged.withColumns({
        "rank_in_part": F.row_number().over(inside),
        "next_in_part": F.lead(F.struct(node)).over(inside),
    })
    across = Window.partitionBy(*keys).orderBy("part")
    parts = (
        ranged.groupBy(*keys, "part")
        .agg(F.count(F.lit(1)).alias("size"), F.min_by(F.struct(node), F.struct(*order)).alias("head"))
        .select(
            *keys, "part",
            F.coalesce(
                F.sum("size").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")
            ).alias("before"),
            F.lead("head").over(across).alias("next_head"),
        )
    )
    return rows.join(parts, keys + ["part"]).select(
        *visits.columns,
        (F.col("before") + F.col("rank_in_part") - 1).alias("pos"),
        F.coalesce("next_in_part", "next_head").getField(node).alias(f"next_{node}"),
    )


def path_steps(paths: DataFrame) -> DataFrame:
    """Consecutive node pairs of array-valued paths: ``path_id, pos, u, v``.

    The pairs are built inside the row: no shuffle, and the last node, which has
    no successor, gives no step.
    """
    n = F.greatest(F.size("path") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("path", 1, n), F.slice("path", 2, n), lambda a, b: F.struct(a.alias("u"), b.alias("v")))
    return (
        paths.filter(F.size("path") > 1)
        .select("path_id", F.posexplode(pairs).alias("pos", "step"))
        .select("path_id", "pos", "step.u", "step.v")
    )
