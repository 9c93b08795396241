"""Distances, line texts and spatial keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius in metres and metres per statute mile.
EARTH_RADIUS_M = 6371008.8
METRES_PER_MILE = 1609.344

_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, (int, float)) else c


def half_chord(lat1, lon1, lat2, lon2) -> Column:
    """Haversine of the central angle; grows with the distance, needs no arcsine."""
    lat1, lon1, lat2, lon2 = (_col(c) for c in (lat1, lon1, lat2, lon2))
    dlat = F.sin(F.radians(lat2 - lat1) / 2)
    dlon = F.sin(F.radians(lon2 - lon1) / 2)
    return dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon


def chord_to_metres(h) -> Column:
    return F.asin(F.sqrt(F.least(F.lit(1.0), _col(h)))) * (2 * EARTH_RADIUS_M)


def geo_distance(lat1, lon1, lat2, lon2, unit: str = "m") -> Column:
    """Great-circle distance on a sphere, in metres (``m``) or miles (``mi``)."""
    metres = chord_to_metres(half_chord(lat1, lon1, lat2, lon2))
    if unit == "m":
        return metres
    if unit == "mi":
        return metres / METRES_PER_MILE
    raise ValueError(f"unknown unit {unit!r}")


def line_text(lat1, lon1, lat2, lon2) -> Column:
    """``"lat lon, lat lon"``."""
    first = F.concat_ws(" ", _col(lat1).cast("string"), _col(lon1).cast("string"))
    second = F.concat_ws(" ", _col(lat2).cast("string"), _col(lon2).cast("string"))
    return F.concat_ws(", ", first, second)


def _points(text: Column, pattern: str) -> Column:
    lons = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    lats = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.transform(
        F.arrays_zip(lons.alias("a"), lats.alias("b")),
        lambda p: F.struct(p["a"].cast("double").alias("lon"), p["b"].cast("double").alias("lat")),
    )


def parse_linestring(wkt) -> Column:
    """WKT ``LINESTRING`` to ``array<struct<lon,lat>>``."""
    return _points(_col(wkt), _NUMBER + r"\s+" + _NUMBER)


def road_from_text(text) -> Column:
    """Stored text of a list of ``(lon, lat)`` tuples to ``array<struct<lon,lat>>``."""
    return _points(_col(text), r"\(" + _NUMBER + r",\s*" + _NUMBER + r"\)")


def road_latlon(road) -> Column:
    """Swap the axes: list of ``[lat, lon]``, the order a map draws."""
    return F.transform(_col(road), lambda p: F.array(p["lat"], p["lon"]))


def _spread(x: Column) -> Column:
    # standard bit spreading: every bit moves to twice its position
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(lat, lon, bits: int = 24) -> Column:
    """Z-order key: points near each other mostly get near keys."""
    side = float(1 << bits)
    x = F.floor((_col(lon) + 180.0) / 360.0 * side).cast("bigint")
    y = F.floor((_col(lat) + 90.0) / 180.0 * side).cast("bigint")
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))
