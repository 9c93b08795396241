"""The route-request job: stream of messages in, answers and a growing path cache out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymesh.operators.levels import Levels
from waymesh.operators.nearest import NodeIndex, index_nodes
from waymesh.operators.requests import answer_requests, misses_of, parse_requests
from waymesh.operators.shortest import route_pairs, shortest_paths
from waymesh.operators.tiles import Tiles, tile_edges
from waymesh.runtime import store
from waymesh.sources.path_store import PathStore
from waymesh.sources.paths import append_paths, open_cache


def start(df: DataFrame, sink: str, checkpoint: str | None = None, path: str | None = None,
          name: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Start an append-mode query into ``console``, ``memory``, ``parquet`` and the like."""
    writer = df.writeStream.outputMode("append").format(sink)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path) if path else writer.start()


def answer_batch(requests: DataFrame, index: NodeIndex, edges: DataFrame | Tiles | Levels, paths: PathStore, load: str) -> DataFrame:
    """Answer one batch from a partitioned cache and keep under ``load`` what had to be searched.

    Pairs without a path are remembered too, so no pair is searched in two batches. ``status``: ``found``,
    ``unreachable`` or ``invalid``.
    """
    spark = requests.sparkSession
    nothing = spark.createDataFrame([], paths.read().schema)
    placed = store(answer_requests(requests, index, nothing).select(*requests.columns, "status")).df
    asked = store(misses_of(placed)).df
    known = store(paths.lookup(asked)).df
    missing = store(asked.join(known.select("node1", "node2"), ["node1", "node2"], "left_anti"))
    if missing.rows:
        new = store(shortest_paths(edges, missing.df).select("node1", "node2", "cost_c", "hops", "path")).df
        paths.append(new, load, asked=missing.df)
        known = known.unionByName(new)
    valid = placed.filter("status <> 'invalid'").drop("status").join(known, ["node1", "node2"], "left")
    answered = valid.withColumn("status", F.when(F.col("path").isNull(), "unreachable").otherwise("found"))
    columns = [*requests.columns, "cost_c", "hops", "path", "status"]
    invalid = placed.filter("status = 'invalid'")
    return answered.select(*columns).unionByName(invalid, allowMissingColumns=True)


def request_job(
    stream: DataFrame, nodes: DataFrame, edges: DataFrame | Tiles, cache_path: str | PathStore, answers_path: str,
    checkpoint: str, available_now: bool = False,
) -> StreamingQuery:
    """Answer route requests: nearest nodes, cache, and shortest paths for the misses.

    Per micro-batch all pairs the cache lacks are computed together and appended once
    per pair; the cache is read anew, so paths of earlier batches are found. Answers
    go to one folder per batch, written over when a batch is repeated after a failure;
    appending skips pairs that are there, so a repeated batch adds nothing twice.
    With a `PathStore` each batch reads the asked buckets only (`answer_batch`).
    """
    index = index_nodes(nodes)
    tiles = edges if isinstance(edges, Tiles) else tile_edges(edges, nodes)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        requests = store(parse_requests(batch)).df
        if isinstance(cache_path, PathStore):
            answers = answer_batch(requests, index, tiles, cache_path, f"batch-{batch_id}")
            answers.write.mode("overwrite").parquet(f"{answers_path}/batch={batch_id}")
            return
        first = store(answer_requests(requests, index, open_cache(spark, cache_path))).df
        _, new = route_pairs(misses_of(first), tiles, open_cache(spark, cache_path))
        append_paths(new, cache_path)
        done = first.filter("status <> 'queued'")
        # what the cache still lacks now has no path
        waiting = first.filter("status = 'queued'").select(*requests.columns)
        late = answer_requests(waiting, index, open_cache(spark, cache_path)).replace(
            {"queued": "unreachable"}, subset=["status"]
        )
        done.unionByName(late).write.mode("overwrite").parquet(f"{answers_path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
