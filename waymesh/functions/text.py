"""Labels, tags and list literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def edge_label(u, v) -> Column:
    """``"(u,v)"``; joins keep using the two columns."""
    return F.concat(F.lit("("), _col(u).cast("string"), F.lit(","), _col(v).cast("string"), F.lit(")"))


def split_label(label) -> Column:
    """Inverse of :func:`edge_label`: ``struct<u,v>``."""
    pattern = r"\((-?\d+),\s*(-?\d+)\)"
    return F.struct(
        F.regexp_extract(_col(label), pattern, 1).try_cast("bigint").alias("u"),
        F.regexp_extract(_col(label), pattern, 2).try_cast("bigint").alias("v"),
    )


def tag_map(tags) -> Column:
    """``array<struct<_k,_v>>`` to a map; of a repeated key the last value counts."""
    c = F.coalesce(_col(tags), F.from_json(F.lit("[]"), "array<struct<_k:string,_v:string>>"))
    last = F.filter(
        F.transform(c, lambda t, i: F.struct(t["_k"].alias("k"), t["_v"].alias("v"), i.alias("i"))),
        lambda t: ~F.exists(F.slice(c, t["i"] + 2, F.size(c)), lambda later: later["_k"] == t["k"]),
    )
    return F.map_from_entries(F.transform(last, lambda t: F.struct(t["k"], t["v"])))


def project_tags(df: DataFrame, keys: list[str], tags: str = "tags") -> DataFrame:
    """The wanted tags as columns, NULL where an element lacks one."""
    return df.select("*", *[F.try_element_at(F.col(tags), F.lit(k)).alias(k) for k in keys])


def parse_id_list(text) -> Column:
    """``"[1, 2, 3]"`` to ``array<bigint>``; NULL when it is not a list of ids."""
    return F.from_json(_col(text), "array<bigint>")
