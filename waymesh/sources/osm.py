"""OpenStreetMap XML, read by Spark's own XML source (one row per element)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh import schemas
from waymesh.functions.text import tag_map


def read_osm_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``id, lat, lon, tags``; elements with a single tag keep it."""
    raw = spark.read.format("xml").option("rowTag", "node").schema(schemas.OSM_NODE).load(path)
    return raw.select(
        F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tag_map("tag").alias("tags")
    )


def read_osm_ways(spark: SparkSession, path: str) -> DataFrame:
    """``way_id, nd array<bigint>, tags``."""
    raw = spark.read.format("xml").option("rowTag", "way").schema(schemas.OSM_WAY).load(path)
    refs = F.transform(F.coalesce("nd", F.array().cast(schemas.OSM_WAY["nd"].dataType)), lambda n: n["_ref"])
    return raw.select(F.col("_id").alias("way_id"), refs.alias("nd"), tag_map("tag").alias("tags"))
