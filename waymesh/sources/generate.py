"""Generated load-test values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_values(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n doubles in [0, 1), the same for the same seed whatever the partitioning."""
    return spark.range(n).select((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1e6).alias("value"))
