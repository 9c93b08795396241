"""Session, checkpoint tables and checked broadcasts shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when a count proved it has at most this many rows.
BROADCAST_ROWS = 100_000


def local_session(cores: str | int = "*", app: str = "waymesh", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster use the session the cluster provides."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WAYMESH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application.

    Functions that run in tasks are found by name there, so the workers need the package
    even if only the driver's path leads to it.
    """
    context = spark.sparkContext
    if getattr(context, "_waymesh_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="waymesh-code-"), "waymesh.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("waymesh", os.path.relpath(path, here)))
    context.addPyFile(archive)
    context._waymesh_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """Folder shared by all executors, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="waymesh-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def task_count(spark: SparkSession) -> int:
    """Number of tasks for steps that are small in bytes but long in computing.

    Adaptive execution would merge their partitions by size; an explicit number of
    partitions is kept. On one machine more tasks than cores only cost time.
    """
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    context = spark.sparkContext
    return min(wanted, context.defaultParallelism) if context.master.startswith("local") else wanted


@dataclass(frozen=True)
class Stored:
    """A written table and the figures observed while it was written."""

    df: DataFrame
    rows: int
    stats: dict


def store(df: DataFrame, **stats) -> Stored:
    """Write ``df`` to the shared checkpoint folder and read it back.

    This cuts the lineage of an iteration, survives the loss of executors and
    gives the planner true sizes. ``stats`` are extra aggregate columns that are
    observed in the same job, so that counting needs no second pass.
    """
    spark = df.sparkSession
    seen = Observation()
    path = f"{checkpoint_root(spark).rstrip('/')}/waymesh/{uuid.uuid4().hex}"
    watched = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        *[column.alias(name) for name, column in stats.items()],
    )
    watched.write.parquet(path)
    found = dict(seen.get)
    return Stored(spark.read.schema(df.schema).parquet(path), found.pop("rows"), found)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is proven to be small.

    The table is written once and counted on the way. Beyond ``max_rows`` the
    plain table is returned and the join shuffles (AQE splits its hot keys).
    """
    kept = store(df)
    return F.broadcast(kept.df) if kept.rows <= max_rows else kept.df
