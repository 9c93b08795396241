"""The load-test map r <- r*r - 0.5, natively and as a Pandas UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iterate_map(value, n: int = 100) -> Column:
    """Apply ``r*r - 0.5`` n times, as a higher-order function inside the JVM."""
    if n == 0:
        return _col(value)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(n)), _col(value).cast("double"), lambda r, _: r * r - F.lit(0.5)
    )


def iterate_map_pandas(value, n: int = 100) -> Column:
    """The same as a Pandas UDF, for comparison in the benchmark."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        r = values.to_numpy(dtype="float64", copy=True)
        for _ in range(n):
            r = r * r - 0.5
        return pd.Series(r)

    return run(_col(value))
