"""Places of items in chains: list ranking by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.operators.components import connected_components
from waymesh.runtime import Stored, store


def _doubled(before: DataFrame, max_rounds: int) -> tuple[Stored, int]:
    """Look back twice as far each round: ``id, to, first, place``, and how many items found no first one.

    ``before``: ``id, to``, the item before (null for a first one). A chain that is not done after a round ends
    some of its items in the next; a round that ends none leaves only rings.
    """
    state = store(
        before.select(
            "id", "to", F.when(F.col("to").isNull(), F.col("id")).alias("first"), F.col("to").isNotNull().cast("bigint").alias("place")
        ),
        open=F.count_if(F.col("to").isNotNull()),
    )
    for _ in range(max_rounds):
        left = state.stats["open"]
        if not left:
            return state, 0
        back = state.df.select(
            F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("first").alias("begin"), F.col("place").alias("further")
        )
        moved = state.df.filter("to IS NOT NULL").join(back, "to").select(
            "id", F.col("beyond").alias("to"), F.col("begin").alias("first"), (F.col("place") + F.col("further")).alias("place")
        )
        state = store(state.df.filter("to IS NULL").unionByName(moved), open=F.count_if(F.col("to").isNotNull()))
        if state.stats["open"] == left:
            return state, left
    raise RuntimeError(f"chains longer than 2 to the power of {max_rounds}")


def chain_places(links: DataFrame, items: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``id, chain, place``: the first item of every item's chain and its place in it, from 0.

    ``links``: ``u, v``, where v follows u; an item has at most one follower and follows at most one. A ring has no
    first item; it begins at its smallest id. Each round doubles the distance an item looks back, so a chain
    of n items needs log2(n) joins, and no chain is ever gathered.
    """
    follows = store(links.select(F.col("v").alias("id"), F.col("u").alias("to"))).df
    state, rings = _doubled(items.select("id").join(follows, "id", "left"), max_rounds)
    places = state.df.filter("to IS NULL").select("id", F.col("first").alias("chain"), "place")
    if not rings:
        return places
    around = store(follows.join(state.df.filter("to IS NOT NULL").select("id"), "id", "left_semi")).df
    least = connected_components(around.select(F.col("to").alias("u"), F.col("id").alias("v")))
    cut = around.join(least, "id").select("id", F.when(F.col("id") != F.col("component"), F.col("to")).alias("to"))
    opened, _ = _doubled(cut, max_rounds)
    return places.unionByName(opened.df.select("id", F.col("first").alias("chain"), "place"))
