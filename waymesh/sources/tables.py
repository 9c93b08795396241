"""CSV and table storage of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh import schemas
from waymesh.functions.geo import road_from_text
from waymesh.operators.cleaning import edges_with_endpoints, merge_nodes

_VERSIONS = {
    ("nodes", 1): schemas.NODES_CSV_V1, ("nodes", 2): schemas.NODES_CSV_V2,
    ("edges", 1): schemas.EDGES_CSV_V1, ("edges", 2): schemas.EDGES_CSV_V2,
}


def _read_csv(spark: SparkSession, path: str, kind: str, version: int) -> DataFrame:
    """Columns are found by their header name, bad values become NULL."""
    schema = _VERSIONS[kind, version]
    raw = spark.read.csv(path, header=True, escape='"', multiLine=False)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


#: Columns a row cannot do without, and the places that exist.
_NEEDED = {("nodes", 1): ("osmid", "lat", "lon"), ("nodes", 2): ("osmid", "y", "x"), ("edges", 1): ("x", "y"), ("edges", 2): ("u", "v")}
_PLACES = {("nodes", 1): {"lat": 90.0, "lon": 180.0}, ("nodes", 2): {"y": 90.0, "x": 180.0}}


def judged_csv(spark: SparkSession, path: str, kind: str, version: int = 2) -> DataFrame:
    """The columns of ``kind`` ("nodes" or "edges") with the line as ``row`` and what is wrong with it as ``reasons``.

    A reason is ``fields`` (more or fewer than the header has) or a column's name with ``missing`` (needed and
    empty), ``type`` (a value that cannot be cast) or ``range`` (a place that does not exist). A line without
    reasons is sound. A line that is short or long is not judged by column, since its values may stand under the wrong names.
    """
    schema = _VERSIONS[kind, version]
    names = spark.read.csv(path, header=True, escape='"').columns
    absent = [n for n in schema.names if n not in names]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    line = T.StructField("_line", T.StringType())
    # fields are only counted if no column is left out while a line is parsed
    raw = spark.read.option("columnPruning", False).csv(
        path, header=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=line.name,
        schema=T.StructType([*[T.StructField(n, T.StringType()) for n in names], line]),
    )
    broken = F.col(line.name).isNotNull()
    checks = []
    for field in schema:
        text, value = F.col(f"`{field.name}`"), F.col(f"`{field.name}`").try_cast(field.dataType)
        if field.name in _NEEDED[kind, version]:
            checks.append(F.when(~broken & text.isNull(), f"{field.name} missing"))
        checks.append(F.when(~broken & text.isNotNull() & value.isNull(), f"{field.name} type"))
        most = _PLACES.get((kind, version), {}).get(field.name)
        if most:
            checks.append(F.when(~broken & (F.abs(value) > most), f"{field.name} range"))
    return raw.select(
        *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema],
        F.coalesce(line.name, F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names]))).alias("row"),
        F.array_compact(F.array(F.when(broken, "fields"), *checks)).alias("reasons"),
    )


def read_nodes_csv(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    """``id, lat, lon`` from either version of ``nodes.csv``."""
    raw = _read_csv(spark, path, "nodes", version)
    lat, lon = ("lat", "lon") if version == 1 else ("y", "x")
    return raw.select(F.col("osmid").alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))


def read_edges_csv(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    """Edges of either version; version 2 carries geometry, version 1 the way id and name."""
    raw = _read_csv(spark, path, "edges", version)
    if version == 1:
        return raw.select(
            F.col("x").alias("u"), F.col("y").alias("v"), F.col("osmid_x").alias("way_id"), "name", "highway",
            "oneway", "weighted_dist",
        )
    cost = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("weighted_distance") * 100 + 0.5).cast("bigint"))
    text = F.col("road")
    road = F.when(text.startswith("[{"), F.from_json(text, schemas.POINTS)).otherwise(road_from_text(text))
    return raw.select(
        "u", "v", "oneway", "weighted_distance", F.when(F.col("weighted_distance").isNotNull(), cost).alias("cost_c"),
        road.alias("road"),
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; nested columns are written as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode(mode).csv(path, header=True, escape='"')


def save_nodes(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store nodes, ordered so that row groups hold neighbouring places and can be skipped."""
    df.sortWithinPartitions("lat", "lon").write.mode(mode).parquet(path)


def load_nodes(
    spark: SparkSession, path: str, existing: DataFrame | None = None, version: int = 1, rejects: str | None = None
) -> DataFrame:
    """Bulk load from CSV, inserting only what is not there yet.

    With a folder for ``rejects`` only sound lines are loaded; the others are added there with their reasons.
    """
    new = read_nodes_csv(spark, path, version)
    if rejects is not None:
        judged = judged_csv(spark, path, "nodes", version)
        judged.filter(F.size("reasons") > 0).select("row", "reasons").write.mode("append").parquet(rejects)
        lat, lon = ("lat", "lon") if version == 1 else ("y", "x")
        new = judged.filter(F.size("reasons") == 0).select(F.col("osmid").alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    return merge_nodes(existing if existing is not None else new.limit(0), new)


def save_edges(edges: DataFrame, nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the edges of which both ends exist."""
    edges_with_endpoints(edges, nodes).write.mode(mode).parquet(path)


def save_edges_table(edges: DataFrame, nodes: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """The same as a catalog table bucketed on ``u``, for joins without a shuffle."""
    edges_with_endpoints(edges, nodes).write.mode(mode).bucketBy(buckets, "u").sortBy("u").saveAsTable(table)
