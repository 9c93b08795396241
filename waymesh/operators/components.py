"""Weakly connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.runtime import store


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """Label every node with the smallest id of its weak component: ``id, component``.

    Each round hooks every node onto the neighbour (or itself) that comes first in a
    pseudo-random order and renames the edges accordingly. Order by hash keeps the
    chains of hooks short, so the edge table shrinks by a constant factor per round:
    the total work is linear and the number of rounds logarithmic. ``u`` and ``v`` may
    be of any type that has an order. ``nodes`` (``id``) adds isolated nodes.
    """
    # the input is evaluated once; loops stay in for the list of nodes
    pairs = store(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        links=F.count_if(F.col("u") != F.col("v")),
    )
    everyone = pairs.df.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    if nodes is not None:
        everyone = everyone.unionByName(nodes.select("id")).distinct()
    links, left = pairs.df.filter(F.col("u") != F.col("v")), pairs.stats["links"]
    hooks: list[DataFrame] = []
    for round_no in range(max_rounds):
        if not left:
            break
        both = F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")),
                       F.struct(F.col("v").alias("id"), F.col("u").alias("other")))

        def draw(c: str):
            return F.struct(F.xxhash64(c, F.lit(round_no)).alias("h"), F.col(c).alias("id"))

        sides = links.select(F.explode(both).alias("p")).select("p.*")
        chosen = sides.groupBy("id").agg(F.min(draw("other")).alias("best")).select(
            "id", F.least("best", draw("id")).getField("id").alias("to")
        )
        # one jump along the hooks; what is left of a chain contracts in the next round
        over = chosen.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        hook = store(chosen.join(over, "to").select("id", F.col("beyond").alias("to"))).df
        hooks.append(hook)
        ends_u = hook.select(F.col("id").alias("u"), F.col("to").alias("nu"))
        ends_v = hook.select(F.col("id").alias("v"), F.col("to").alias("nv"))
        kept = store(
            links.join(ends_u, "u").join(ends_v, "v").filter(F.col("nu") != F.col("nv"))
            .select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).distinct()
        )
        links, left = kept.df, kept.rows
    else:
        raise RuntimeError(f"links are left after {max_rounds} rounds")
    # follow the hooks from the last, smallest table back to all nodes
    final: DataFrame | None = None
    for hook in reversed(hooks):
        if final is None:
            final = hook
        else:
            root = final.select(F.col("id").alias("to"), F.col("to").alias("root"))
            final = hook.join(root, "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    if final is None:
        return everyone.select("id", F.col("id").alias("component"))
    member = store(everyone.join(final, "id", "left").select("id", F.coalesce("to", "id").alias("root"))).df
    names = member.groupBy("root").agg(F.min("id").alias("component"))
    return member.join(names, "root").select("id", "component")


def component_sizes(components: DataFrame) -> DataFrame:
    """``component, size``."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(components: DataFrame) -> DataFrame:
    """Ids of the largest component; of equally large ones the smallest label wins."""
    top = component_sizes(components).orderBy(F.desc("size"), "component").limit(1).select("component")
    return components.join(top, "component", "left_semi").select("id")


def keep_largest(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the largest weak component."""
    kept = store(largest_component(connected_components(edges, nodes))).df
    return (
        nodes.join(kept, "id", "left_semi"),
        edges.join(kept, edges["u"] == kept["id"], "left_semi"),
    )
