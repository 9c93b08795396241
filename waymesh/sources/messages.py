"""Route-request messages: a Kafka topic, or JSON-lines files in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_requests(spark: SparkSession, fmt: str = "kafka", options: dict | None = None, path: str | None = None) -> DataFrame:
    """Stream of messages with a string ``value``.

    ``fmt="kafka"`` needs the connector package and ``kafka.bootstrap.servers`` and
    ``subscribe``; ``fmt="text"`` takes one message per line from a folder.
    """
    reader = spark.readStream.format(fmt).options(**(options or {}))
    return (reader.load(path) if path else reader.load()).select(F.col("value").cast("string").alias("value"))


def miss_messages(pairs: DataFrame) -> DataFrame:
    """Queued pairs as message values ``{"node1":…,"node2":…}``."""
    return pairs.select(F.to_json(F.struct("node1", "node2")).alias("value"))


def publish_misses(pairs: DataFrame, fmt: str = "kafka", options: dict | None = None, path: str | None = None) -> None:
    """Send queued pairs to a topic, or append them to a folder of text files."""
    writer = miss_messages(pairs).write.format(fmt).options(**(options or {})).mode("append")
    writer.save(path) if path else writer.save()
