"""Storage of computed paths: the cache table, the JSON export and the path log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh import schemas
from waymesh.functions.text import parse_id_list
from waymesh.operators.cache import one_per_pair

CACHE_SCHEMA = "node1 bigint, node2 bigint, cost_c bigint, hops int, path array<bigint>"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The path cache at ``path``; empty if nothing was stored yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def append_paths(new: DataFrame, path: str) -> None:
    """Append paths of pairs the cache does not hold yet."""
    cache = open_cache(new.sparkSession, path)
    fresh = one_per_pair(new).join(cache.select("node1", "node2"), ["node1", "node2"], "left_anti")
    fresh.select(*[f.split()[0] for f in CACHE_SCHEMA.split(", ")]).write.mode("append").parquet(path)


def export_entries(paths: DataFrame) -> DataFrame:
    """One line of JSON per path, ``{key: {x, y, path}}``; the key is a hash of the pair."""
    key = F.md5(F.concat_ws(":", F.col("node1").cast("string"), F.col("node2").cast("string"), F.to_json("path")))
    entry = F.struct(F.col("node1").alias("x"), F.col("node2").alias("y"), "path")
    return paths.select(F.to_json(F.create_map(key, entry)).alias("value"))


def parse_export(text: DataFrame) -> DataFrame:
    """Inverse of :func:`export_entries`, for objects with any number of paths."""
    entries = text.select(F.explode(F.from_json("value", schemas.PATH_EXPORT)).alias("path_id", "p"))
    return entries.select("path_id", F.col("p.x").alias("node1"), F.col("p.y").alias("node2"), F.col("p.path").alias("path"))


def write_path_export(paths: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the export as text, one object per line."""
    export_entries(paths).write.mode(mode).text(path)


def read_path_export(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Read an export; ``whole_files`` for files that are one object over many lines."""
    return parse_export(spark.read.text(path, wholetext=whole_files))


def parse_path_log(lines: DataFrame) -> DataFrame:
    """Log lines split at ``:``; both nodes are the second word of fields 3 and 4, the path is last."""
    fields = F.split("value", ":")

    def node(i: int):
        word = F.get(F.split(F.get(fields, F.lit(i)), " "), F.lit(1))
        return F.btrim(word, F.lit(",")).try_cast("bigint")

    path = F.btrim(F.btrim(F.try_element_at(fields, F.lit(-1))), F.lit("}"))
    return lines.select(node(2).alias("node1"), node(3).alias("node2"), parse_id_list(path).alias("path")).filter(
        "node1 IS NOT NULL AND node2 IS NOT NULL AND path IS NOT NULL"
    )


def read_path_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_path_log(spark.read.text(path))
