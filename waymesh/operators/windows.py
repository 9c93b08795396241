"""Edge tables stored by place, and map windows that read only the parts they need.

A window is a rectangle; along the Z-curve it falls into a few ranges of keys. Edges stored with the keys of both ends
and ordered by the first are skipped by files and row groups whose keys lie outside those ranges.
"""

from __future__ import annotations

from functools import reduce
from math import floor
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions.geo import morton

if TYPE_CHECKING:
    from waymesh.operators.graph import Box

BITS = 24
#: Ranges of a window at most; more follow its rim more closely, but make longer filters.
MOST_RANGES = 32
PLACE_COLUMNS = ["lat_u", "lon_u", "lat_v", "lon_v", "z_u", "z_v"]


def z_ranges(box: Box, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of Z-keys, both ends included, that hold every point of the box.

    The square of all keys is divided into four again and again; squares outside the box go, squares inside stay
    whole, and those on the rim are divided while there is room.
    """
    side = float(1 << BITS)
    x0, x1 = (floor((lon + 180.0) / 360.0 * side) for lon in (box.west, box.east))
    y0, y1 = (floor((lat + 90.0) / 180.0 * side) for lat in (box.south, box.north))
    inside: list[tuple[int, int]] = []
    rim = [(0, 0, 0, BITS + 1)]  # first key, x, y, log2 of the side
    while rim and rim[0][3] and len(inside) + 4 * len(rim) <= 4 * most:
        finer = []
        for key, x, y, level in rim:
            half = level - 1
            for quarter in range(4):
                qx, qy = x + ((quarter & 1) << half), y + ((quarter >> 1) << half)
                ex, ey = qx + (1 << half) - 1, qy + (1 << half) - 1
                if qx > x1 or ex < x0 or qy > y1 or ey < y0:
                    continue
                cell = (key + (quarter << 2 * half), qx, qy, half)
                if qx >= x0 and ex <= x1 and qy >= y0 and ey <= y1:
                    inside.append((cell[0], cell[0] + (1 << 2 * half) - 1))
                else:
                    finer.append(cell)
        rim = finer
    ranges: list[tuple[int, int]] = []
    for low, high in sorted(inside + [(key, key + (1 << 2 * level) - 1) for key, _, _, level in rim]):
        if ranges and low <= ranges[-1][1] + 1:
            ranges[-1] = (ranges[-1][0], high)
        else:
            ranges.append((low, high))
    while len(ranges) > most:  # close the smallest gap
        k = min(range(len(ranges) - 1), key=lambda i: ranges[i + 1][0] - ranges[i][1])
        ranges[k:k + 2] = [(ranges[k][0], ranges[k + 1][1])]
    return ranges


def with_places(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the coordinates and Z-keys of both ends; edges without both ends in ``nodes`` go."""

    def end(side: str) -> DataFrame:
        return nodes.filter("lat IS NOT NULL AND lon IS NOT NULL").select(
            F.col("id").alias(side), F.col("lat").alias(f"lat_{side}"), F.col("lon").alias(f"lon_{side}"), morton("lat", "lon", BITS).alias(f"z_{side}")
        )

    return edges.join(end("u"), "u").join(end("v"), "v").select(*edges.columns, *PLACE_COLUMNS)


def save_edges_by_place(edges: DataFrame, nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write edges with their places, range-partitioned and sorted by the key of their start."""
    placed = with_places(edges, nodes)
    placed.repartitionByRange("z_u", "u").sortWithinPartitions("z_u", "u").write.mode(mode).parquet(path)


def load_edges_by_place(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def edges_in_window(placed: DataFrame, box: Box, most: int = MOST_RANGES) -> DataFrame:
    """Edges of a table with places that have both ends in the box, without a join; the place columns go."""
    ranges = z_ranges(box, most)

    def within(side: str) -> Column:
        return reduce(lambda a, b: a | b, [F.col(f"z_{side}").between(low, high) for low, high in ranges])

    kept = placed.filter(within("u") & within("v")).filter(box.holds("lat_u", "lon_u") & box.holds("lat_v", "lon_v"))
    return kept.drop(*PLACE_COLUMNS)
