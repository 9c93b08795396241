"""Simplifying a network: contract chains, merge nearby intersections."""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import ceil, pi, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from waymesh.functions.geo import EARTH_RADIUS_M, geo_distance
from waymesh.operators.components import connected_components
from waymesh.operators.graph import simple_edges
from waymesh.operators.ranking import chain_places
from waymesh.runtime import store


def chain_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that only pass traffic on: two neighbours, and one or both directions right through.

    A node with parallel edges to a neighbour is a junction.
    """
    ends = F.array(
        F.struct(F.col("u").alias("id"), F.col("v").alias("other"), F.lit(1).alias("out")),
        F.struct(F.col("v").alias("id"), F.col("u").alias("other"), F.lit(0).alias("out")),
    )
    sides = edges.select("u", "v").select(F.explode(ends).alias("e")).select("e.*")
    per_pair = sides.groupBy("id", "other").agg(
        F.sum("out").alias("outs"), F.sum(1 - F.col("out")).alias("ins")
    )
    return (
        per_pair.groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("others"), F.sum("outs").alias("outs"), F.sum("ins").alias("ins"),
            F.max(F.greatest("outs", "ins")).alias("parallel"), F.max((F.col("id") == F.col("other")).cast("int")).alias("loop"),
        )
        .filter("others = 2 AND loop = 0 AND parallel = 1 AND outs = ins AND outs > 0")
        .select("id")
    )


def simplify_chains(edges: DataFrame) -> DataFrame:
    """Contract chains of pass-through nodes into single directed edges, drawn as one line.

    Takes directed edges ``u, v, length_m, highway, maxspeed``, unique per pair of ends (per ends and ``way_id`` if
    there is one). Gives ``u, v, length_m, pieces, highway, maxspeed`` with the different classes and speeds as
    sorted arrays, and for the columns that are there: ``cost_c`` (sum), ``oneway``, ``road`` (the points of
    all pieces in order), ``way_ids`` and ``names`` (in order, without repeats and nulls in a row).

    List ranking gives every piece its place in the chain, so chains of any length contract in a logarithmic
    number of rounds. A ring without any junction becomes a loop at the start of its smallest piece.
    """
    optional = [c for c in ("cost_c", "oneway", "road", "way_id", "name") if c in edges.columns]
    key = ["u", "v", "way_id"] if "way_id" in optional else ["u", "v"]
    edges = store(edges.select("u", "v", "length_m", "highway", "maxspeed", *optional).withColumn("id", F.struct(*key))).df
    passing = store(chain_nodes(edges)).df
    into = edges.select(F.col("id").alias("a"), F.col("v").alias("node"), F.col("u").alias("before"))
    out_of = edges.select(F.col("id").alias("b"), F.col("u").alias("node"), F.col("v").alias("after"))
    through = passing.withColumnRenamed("id", "node")
    # one row per pass-through node and direction: its two pieces belong together
    linked = (
        into.join(through, "node", "left_semi").join(out_of.join(through, "node", "left_semi"), "node")
        .filter("before != after").select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    placed = edges.join(chain_places(linked, edges.select("id")), "id")
    fields = ["place", "u", "v", "length_m", "highway", "maxspeed", *optional]
    chains = placed.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("steps"))

    def sets(column: str) -> Column:
        """The different values of pieces (or the entries of their lists), sorted."""
        values = F.transform("steps", lambda s: s[column])
        if isinstance(edges.schema[column].dataType, ArrayType):
            values = F.flatten(F.filter(values, lambda x: x.isNotNull()))
        return F.array_sort(F.array_distinct(F.array_compact(values)))

    def total(column: str) -> Column:
        return F.aggregate("steps", F.lit(0).cast(edges.schema[column].dataType), lambda sum, s: sum + s[column])

    def changes(column: str) -> Column:
        new = F.filter("steps", lambda s, k: s[column].isNotNull() & ~s[column].eqNullSafe(F.get("steps", k - 1)[column]))
        return F.transform(new, lambda s: s[column])

    # a piece begins where the one before it ends
    line = F.flatten(F.transform("steps", lambda s, k: F.when(k == 0, s["road"]).otherwise(F.slice(s["road"], 2, F.greatest(F.size(s["road"]) - 1, F.lit(0))))))
    made = {"cost_c": lambda: total("cost_c").alias("cost_c"), "oneway": lambda: F.exists("steps", lambda s: s["oneway"]).alias("oneway"),
            "road": lambda: line.alias("road"), "way_id": lambda: changes("way_id").alias("way_ids"), "name": lambda: changes("name").alias("names")}
    return chains.select(
        F.get("steps", F.lit(0))["u"].alias("u"), F.element_at("steps", -1)["v"].alias("v"), total("length_m").alias("length_m"),
        F.size("steps").cast("bigint").alias("pieces"), sets("highway").alias("highway"), sets("maxspeed").alias("maxspeed"),
        *[made[c]() for c in optional],
    )


SPLIT = 4
PAIRS_PER_JOIN = 4096
AXES = ("x", "y", "z")
_ROUNDING_M = 1e-6
_MAX_DEPTH = 16


def close_links(nodes: DataFrame, reach_m: float) -> DataFrame:
    """Links that join all nodes within ``reach_m`` of each other into components.

    Places are points in space, in metres, so poles and the antimeridian are like any
    other place; the reach is taken as a chord. Not every close pair is written: nodes of
    one grid cell, whose diagonal is below the reach, hang on the cell's smallest id, and two
    neighbouring cells need a single link. Cells are compared part by part: parts entirely
    within reach are linked as they are, parts entirely out of reach are dropped. Of the rest,
    parts with few nodes are measured node by node and crowded ones are divided again, so a
    place that holds a large share of all nodes is never paired with itself or another.
    """
    around = F.cos(F.radians("lat")) * EARTH_RADIUS_M
    spots = store(
        nodes.filter("lat IS NOT NULL AND lon IS NOT NULL").select(
            "id", "lat", "lon", (around * F.cos(F.radians("lon"))).alias("x"), (around * F.sin(F.radians("lon"))).alias("y"),
            (F.sin(F.radians("lat")) * EARTH_RADIUS_M).alias("z"),
        )
    )
    if not spots.rows:
        return nodes.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
    chord = 2 * EARTH_RADIUS_M * sin(min(reach_m / (2 * EARTH_RADIUS_M), pi / 2))
    side = chord / 1.8  # 1.8 > sqrt(3): the diagonal stays below the reach
    far = ceil(chord / side)

    def grid(name: str, parts: int):
        return [F.floor(F.col(axis) / (side / parts)).cast("bigint").alias(f"{name}{axis}") for axis in AXES]

    cell, part = [f"c{axis}" for axis in AXES], [f"q{axis}" for axis in AXES]
    placed = store(spots.df.select("*", *grid("c", 1))).df
    heads = placed.groupBy(*cell).agg(F.min("id").alias("head"))
    links = placed.join(heads, cell).filter("id != head").select(F.col("head").alias("u"), F.col("id").alias("v"))

    def boxes(depth: int, prefix: str) -> DataFrame:
        """Parts of the cells: node count, smallest id and the box the nodes really fill."""
        ends = [(low(axis).alias(f"{name}{axis}")) for axis in AXES for name, low in (("l", F.min), ("h", F.max))]
        table = placed.select("*", *grid("q", SPLIT**depth)).groupBy(*cell, *part).agg(
            F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("lat").alias("lat"), F.min("lon").alias("lon"), *ends
        )
        return table.select(*[F.col(c).alias(prefix + c) for c in table.columns])

    def compared(pairs: DataFrame):
        def length(parts: list):
            return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))

        gaps = [F.greatest(F.lit(0.0), F.col(f"bl{i}") - F.col(f"ah{i}"), F.col(f"al{i}") - F.col(f"bh{i}")) for i in AXES]
        spans = [F.greatest(f"bh{i}", f"ah{i}") - F.least(f"bl{i}", f"al{i}") for i in AXES]
        least, most = length(gaps) - _ROUNDING_M, length(spans) + _ROUNDING_M
        single = reduce(lambda a, b: a & b, [F.col(f"{p}l{i}") == F.col(f"{p}h{i}") for p in "ab" for i in AXES])
        exact = geo_distance("alat", "alon", "blat", "blon") <= reach_m
        return pairs.select(
            *[c for c in pairs.columns if c[1:] in (*cell, *part)],
            F.col("aid").alias("u"), F.col("bid").alias("v"), (F.col("an") * F.col("bn") > PAIRS_PER_JOIN).alias("crowded"),
            F.when(single, exact).otherwise(most <= chord).alias("sure"),
            F.when(single, exact).otherwise(least <= chord).alias("maybe"),
        ).filter("maybe")

    steps = range(-far, far + 1)
    ahead = [d for d in product(steps, repeat=len(AXES)) if d > (0,) * len(AXES)]
    shifts = F.array(*[F.struct(*[F.lit(n).alias(axis) for n, axis in zip(d, AXES, strict=True)]) for d in ahead])
    mine = boxes(1, "a").select("*", F.explode(shifts).alias("d")).withColumns(
        {f"bc{axis}": F.col(f"ac{axis}") + F.col(f"d.{axis}") for axis in AXES}
    ).drop("d")
    met = store(compared(mine.join(boxes(1, "b"), [f"b{c}" for c in cell])), crowded=F.count_if("crowded"))
    cells = [f"{p}{c}" for p in "ab" for c in cell]
    for depth in range(1, _MAX_DEPTH + 1):
        sure = met.df.filter("sure").groupBy(*cells).agg(F.min(F.struct("u", "v")).alias("l"))
        links = links.unionByName(sure.select("l.*"))
        left = met.df.filter("NOT sure").join(sure.select(*cells), cells, "left_anti")
        parts = placed.select("*", *grid("q", SPLIT**depth))
        of_a, of_b = (
            parts.select(*[F.col(c).alias(f"{p}{c}") for c in (*cell, *part, "id", "lat", "lon")]) for p in "ab"
        )
        near = geo_distance("alat", "alon", "blat", "blon") <= reach_m
        measured = (
            left.filter("NOT crowded").drop("u", "v")
            .join(of_a, [f"a{c}" for c in (*cell, *part)]).join(of_b, [f"b{c}" for c in (*cell, *part)]).filter(near)
            .groupBy(*cells).agg(F.min(F.struct(F.col("aid").alias("u"), F.col("bid").alias("v"))).alias("l"))
        )
        links = links.unionByName(measured.select("l.*"))
        if not met.stats["crowded"]:
            return links
        crowded = left.filter("crowded").select(
            *cells, *[F.col(f"{p}{c}").alias(f"{p}{c}_up") for p in "ab" for c in part]
        )

        def finer(prefix: str) -> DataFrame:
            ups = {f"{prefix}{q}_up": F.floor(F.col(f"{prefix}{q}") / SPLIT) for q in part}
            return boxes(depth + 1, prefix).withColumns(ups)

        def up(prefix: str) -> list[str]:
            return [f"{prefix}{c}" for c in cell] + [f"{prefix}{q}_up" for q in part]

        pairs = crowded.join(finer("a"), up("a")).join(finer("b"), up("b"))
        met = store(compared(pairs), crowded=F.count_if("crowded"))
    raise RuntimeError("nodes at different places share the finest part")


def consolidate(nodes: DataFrame, edges: DataFrame, tol_m: float) -> tuple[DataFrame, DataFrame]:
    """Merge intersections whose surroundings of ``tol_m`` touch, transitively.

    Merged nodes take the smallest id and the mean coordinates (on the shorter way round
    where they lie on both sides of the antimeridian). Edges are rewired, loops dropped,
    and of several edges of a pair the cheapest stays.
    """
    groups = store(connected_components(close_links(nodes, 2 * tol_m), nodes)).df
    merged = nodes.join(groups, "id").groupBy(F.col("component").alias("id")).agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("merged"),
        (F.max("lon") - F.min("lon") > 180).alias("across"), F.avg(F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon"))).alias("east"),
    )
    east = F.when(F.col("east") > 180, F.col("east") - 360).otherwise(F.col("east"))
    merged = merged.withColumn("lon", F.when(F.col("across"), east).otherwise(F.col("lon"))).drop("across", "east")
    new_u = groups.select(F.col("id").alias("u"), F.col("component").alias("nu"))
    new_v = groups.select(F.col("id").alias("v"), F.col("component").alias("nv"))
    rewired = edges.join(new_u, "u").join(new_v, "v").withColumns({"u": F.col("nu"), "v": F.col("nv")}).drop("nu", "nv")
    return merged, simple_edges(rewired)
