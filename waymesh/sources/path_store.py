"""A path cache in hash partitions of the pair: looked up, not scanned.

Layout: ``<root>/load=<name>/bucket=<b>/*.parquet``. Every load is one folder that is written over when its batch is
repeated, and it counts only once Spark's commit mark is in it, so a batch that is repeated or broke off in between
adds nothing twice. `PathStore.compact` folds the loads into a generation; its note, written last, names the loads
that it replaces, and they are removed after that. A pair without a path is kept with a null path, so it is not
searched again. A lookup reads the buckets of the asked pairs only; their numbers, at most ``buckets``, are all that
reaches the driver.

One writer at a time; readers that began before a compaction may have to repeat.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.operators.cache import one_per_pair
from waymesh.sources.paths import CACHE_SCHEMA

COLUMNS = ["node1", "node2", "cost_c", "hops", "path"]


class PathStore:
    """Paths by pair under one folder; ``buckets`` is fixed by the first use of the folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stated = [n.split("=")[1] for n in self._names(self.root) if n.startswith("buckets=")]
        if stated and int(stated[0]) != buckets:
            raise ValueError(f"the store has {stated[0]} buckets, not {buckets}")
        self._fs.mkdirs(self._path(f"{self.root}/buckets={buckets}"))

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _replaced(self) -> set[str]:
        """Loads that a finished generation holds already; its note lists them as folders."""
        return {old for note in self._notes() for old in self._names(f"{self.root}/notes/{note}")}

    def _notes(self) -> set[str]:
        """Generations whose note is whole; one still being written begins with a dot."""
        return {n for n in self._names(f"{self.root}/notes") if not n.startswith(".")}

    def loads(self) -> list[str]:
        """The names of the loads that count: committed, not folded into a generation; a generation only with its note."""
        notes, gone = self._notes(), self._replaced()
        names = [n.removeprefix("load=") for n in self._names(self.root) if n.startswith("load=")]
        return sorted(
            n for n in names
            if n not in gone and (not n.startswith("gen-") or n in notes)
            and self._fs.exists(self._path(f"{self.root}/load={n}/_SUCCESS"))
        )

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("node1").cast("bigint"), F.col("node2").cast("bigint")), F.lit(self.buckets)).cast("int")

    def read(self, chosen: list[int] | None = None) -> DataFrame:
        """All entries, or those of some buckets (a filter on the partition column, so other files are not listed)."""
        loads = self.loads()
        if not loads:
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        found = self.spark.read.schema(CACHE_SCHEMA + ", bucket int").option("basePath", self.root).parquet(
            *[f"{self.root}/load={n}" for n in loads]
        )
        return (found if chosen is None else found.filter(F.col("bucket").isin(chosen))).select(*COLUMNS)

    def lookup(self, pairs: DataFrame) -> DataFrame:
        """``node1, node2, cost_c, hops, path`` of the asked pairs that are known; the path is null where there is none."""
        asked = pairs.select("node1", "node2").distinct()
        chosen = [r[0] for r in asked.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        return one_per_pair(self.read(chosen), asked)

    def _write(self, rows: DataFrame, load: str) -> None:
        # a bucket is dealt over a few tasks, so that a hot one is no single file
        spread = F.pmod(F.xxhash64("node2", "node1", F.lit(1)), F.lit(4))
        rows.select(*COLUMNS, self._bucket().alias("bucket")).repartition(F.col("bucket"), spread).sortWithinPartitions(
            "bucket", "node1", "node2"
        ).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/load={load}")

    def append(self, new: DataFrame, load: str, asked: DataFrame | None = None) -> bool:
        """Keep ``new`` under a name of its own; pairs of ``asked`` without a row in it are remembered as having no path.

        A repeated name replaces what it brought before; one that a generation holds already adds nothing (``False``).
        """
        if "=" in load or "/" in load or load.startswith("gen-"):
            raise ValueError(f"not a name of a load: {load}")
        if load in self._replaced():
            return False
        rows = one_per_pair(new.select(*COLUMNS))
        if asked is not None:
            lacking = asked.select("node1", "node2").distinct().join(rows.select("node1", "node2"), ["node1", "node2"], "left_anti")
            rows = rows.unionByName(lacking, allowMissingColumns=True)
        self._write(rows, load)
        return True

    def compact(self) -> str | None:
        """Fold all loads into one generation, one entry per pair, and remove them."""
        loads = self.loads()
        if len(loads) < 2:
            return None
        name = f"gen-{uuid.uuid4().hex}"
        # an entry with a path goes before one without: null costs come last
        rows = self.read().select("node1", "node2", F.col("path").isNull().alias("none"), "cost_c", "hops", "path")
        best = rows.groupBy("node1", "node2").agg(F.min(F.struct("none", "cost_c", "hops", "path")).alias("best"))
        self._write(best.select("node1", "node2", "best.cost_c", "best.hops", "best.path"), name)
        # notes of earlier generations stay readable through this one
        for old in [*loads, *self._replaced()]:
            self._fs.mkdirs(self._path(f"{self.root}/notes/.{name}/{old}"))
        self._fs.rename(self._path(f"{self.root}/notes/.{name}"), self._path(f"{self.root}/notes/{name}"))
        # also those that a compaction before noted, but did not come to remove
        for old in self._replaced():
            self._fs.delete(self._path(f"{self.root}/load={old}"), True)
        return name
