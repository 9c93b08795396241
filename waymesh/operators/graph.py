"""Edge tables as graphs: direction, simple edges, neighbours, samples and windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geo import EARTH_RADIUS_M
from waymesh.operators.windows import edges_in_window
from waymesh.runtime import store

# Fixed value: metres of one degree used for the margin of a window.
METRES_PER_DEGREE = 111045


def directed_edges(edges: DataFrame) -> DataFrame:
    """Every edge, and the way back for two-way ones, from a single scan.

    A ``road`` column is turned round together with the ends.
    """
    rest = [c for c in edges.columns if c not in ("u", "v", "road")]
    geometry = "road" in edges.columns

    def end(u: str, v: str, back: bool):
        fields = [F.col(u).alias("u"), F.col(v).alias("v")]
        if geometry:
            fields.append((F.reverse("road") if back else F.col("road")).alias("road"))
        return F.struct(*fields)

    forth, back = end("u", "v", False), end("v", "u", True)
    both = F.when(F.col("oneway"), F.array(forth)).otherwise(F.array(forth, back))
    return edges.select(*rest, F.explode(both).alias("end")).select("end.*", *rest)


def simple_edges(edges: DataFrame, directed: bool = True, cost: str = "cost_c") -> DataFrame:
    """One edge per pair: the cheapest, then the one with the smallest other columns.

    Undirected pairs are written with the smaller id first; self loops go.
    ``min`` over a struct combines before the shuffle, so hubs do no harm.
    """
    rest = [c for c in edges.columns if c not in ("u", "v", cost)]
    table = edges.filter(F.col("u") != F.col("v"))
    if not directed:
        table = table.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})
    best = table.groupBy("u", "v").agg(F.min(F.struct(cost, *rest)).alias("best"))
    return best.select("u", "v", "best.*")


def edges_to(edges: DataFrame, node: int) -> DataFrame:
    """Edges that end at ``node``."""
    return edges.filter(F.col("v") == node)


def one_way(edges: DataFrame) -> DataFrame:
    """One-way edges only."""
    return edges.filter("oneway")


def neighbors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct out-neighbours of the given nodes with their cost: ``id, next, cost_c``."""
    asked = nodes.select("id").distinct()
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("next"), "cost_c")
    return out.join(asked, "id", "left_semi").distinct()


def node_sample(nodes: DataFrame, k: int, seed: str = "0") -> DataFrame:
    """k nodes in random but reproducible order, as a top-k that never sorts everything."""
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    return nodes.select("id", rank.alias("draw")).orderBy("draw", "id").limit(k)


def sample_pairs(nodes: DataFrame, k: int, seed: str = "0") -> DataFrame:
    """All ordered pairs of different nodes of a k-node sample: ``node1, node2``.

    The sample has at most k rows by definition of the operator. Each node is met
    with the node ``step`` places further on, an equi-join on the place.
    """
    drawn = store(node_sample(nodes, k, seed))
    size = drawn.rows
    placed = drawn.df.agg(F.array_sort(F.collect_list(F.struct("draw", "id"))).alias("all")).select(
        F.posexplode("all").alias("place", "node")
    ).select("place", F.col("node.id").alias("id"))
    if size < 2:
        return placed.select(F.col("id").alias("node1"), F.col("id").alias("node2")).limit(0)
    first = placed.select(
        F.col("id").alias("node1"), F.explode(F.sequence(F.lit(1), F.lit(size - 1))).alias("step"), "place"
    ).select("node1", ((F.col("place") + F.col("step")) % size).alias("place"))
    return first.join(placed.withColumnRenamed("id", "node2"), "place").select("node1", "node2")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair once, without pairs of a node with itself."""
    return pairs.filter(F.col("node1") != F.col("node2")).distinct()


@dataclass(frozen=True)
class Box:
    """A map window in degrees; windows across the antimeridian are refused."""

    south: float
    west: float
    north: float
    east: float

    def __post_init__(self):
        if self.south > self.north or self.west > self.east:
            raise ValueError("box corners are swapped or cross the antimeridian")

    @classmethod
    def of_corners(cls, c1: tuple[float, float], c2: tuple[float, float]) -> "Box":
        """From any two opposite ``(lat, lon)`` corners."""
        return cls(min(c1[0], c2[0]), min(c1[1], c2[1]), max(c1[0], c2[0]), max(c1[1], c2[1]))

    def grown(self) -> "Box":
        """Wider by half the corner distance on every side, in degrees."""
        from math import asin, cos, radians, sin, sqrt

        h = (
            sin(radians(self.north - self.south) / 2) ** 2
            + cos(radians(self.south)) * cos(radians(self.north)) * sin(radians(self.east - self.west) / 2) ** 2
        )
        margin = 2 * EARTH_RADIUS_M * asin(sqrt(min(1.0, h))) / (METRES_PER_DEGREE * 2)
        return Box(self.south - margin, self.west - margin, self.north + margin, self.east + margin)

    def holds(self, lat="lat", lon="lon"):
        """Inclusive test on two plain columns, which scans can push down."""
        return F.col(lat).between(self.south, self.north) & F.col(lon).between(self.west, self.east)


def edges_in_box(nodes: DataFrame, edges: DataFrame, box: Box) -> DataFrame:
    """Edges with both ends inside the box.

    A table stored by place (:mod:`waymesh.operators.windows`) is filtered as it is read; others are joined with the nodes.
    """
    if "z_u" in edges.columns:
        return edges_in_window(edges, box)
    inside = nodes.filter(box.holds()).select("id")
    return (
        edges.join(inside, edges["u"] == inside["id"], "left_semi")
        .join(inside, edges["v"] == inside["id"], "left_semi")
    )


def bbox_subgraph(
    nodes: DataFrame, edges: DataFrame, c1: tuple[float, float], c2: tuple[float, float],
    grow: bool = True, directed: bool = False,
) -> DataFrame:
    """Simple graph of the edges inside the box of two corners, grown by default."""
    box = Box.of_corners(c1, c2)
    return simple_edges(edges_in_box(nodes, edges, box.grown() if grow else box), directed)
