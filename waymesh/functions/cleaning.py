"""Speed, class and cost expressions for raw road segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default speed in mph per road class.
DEFAULT_MPH = {
    "tertiary": 30.0,
    "service": 20.0,
    "residential": 20.0,
    "secondary": 25.0,
    "primary": 60.0,
    "trunk": 60.0,
    "trunk_link": 60.0,
    "primary_link": 60.0,
    "secondary_link": 25.0,
}

# Spellings that mark a one-way road.
ONEWAY_TEXT = ["yes", "true", "1"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_class(highway) -> Column:
    """First class of a list-valued ``highway``; NULL for an empty list."""
    return F.get(_col(highway), 0)


def parse_speed(maxspeed) -> Column:
    """Speed of an ``array<string>`` of raw values as int.

    Each element counts with its first token. One value: that number, zero means
    missing. Several: the truncated mean. Any malformed element: missing.
    """
    numbers = F.transform(
        _col(maxspeed),
        lambda raw: F.get(F.split(F.trim(raw), r"\s+"), 0).try_cast("int"),
    )
    total = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    # total is NULL as soon as one element is, and try_divide covers the empty list
    return F.nullif(F.try_divide(total, F.size(numbers)).cast("int"), F.lit(0))


def default_speed(highway, maxspeed) -> Column:
    """Posted speed in mph, else the class default, else 0.0."""
    posted = F.trim(F.btrim(_col(maxspeed), F.lit("mph"))).try_cast("double")
    defaults = F.create_map(*[F.lit(x) for pair in DEFAULT_MPH.items() for x in pair])
    return F.coalesce(posted, F.try_element_at(defaults, _col(highway)), F.lit(0.0))


def travel_cost(length_m, speed) -> Column:
    """Travel cost in whole hundredths of length/speed, at least 1.

    Integers make path sums independent of their order. A missing or zero speed
    gives NULL, and the edge takes no part in routing.
    """
    ratio = F.try_divide(_col(length_m) * 100, _col(speed).cast("double"))
    cost = F.floor(ratio + 0.5).cast("bigint")
    return F.when(cost.isNotNull(), F.greatest(F.lit(1).cast("bigint"), cost))


def weighted_dist(speed, miles) -> Column:
    """First-version cost: speed times miles, missing parts count as zero."""
    return F.coalesce(_col(speed), F.lit(0.0)) * F.coalesce(_col(miles), F.lit(0.0))


def is_oneway(flag) -> Column:
    """Boolean from the various spellings of ``oneway``; missing means two-way."""
    text = F.lower(F.trim(_col(flag).cast("string")))
    return F.coalesce(text.isin(ONEWAY_TEXT), F.lit(False))
