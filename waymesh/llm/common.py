"""What the text operators share: tables, texts without nulls, a folder of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text of a row; a missing one counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def utf8_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text: the same for equal texts, distinct for all others."""
    return F.unhex(F.md5(text.cast("binary")))


def slices(batch: pd.DataFrame, texts: pd.Series, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """An Arrow batch in parts of at most ``most`` octets of ``texts``; a longer single row comes alone."""
    begin = total = 0
    for k, text in enumerate(texts):
        octets = len(text) if text.isascii() else len(text.encode())
        if k > begin and total + octets > most:
            yield batch.iloc[begin:k]
            begin, total = k, 0
        total += octets
    if begin < len(batch):
        yield batch.iloc[begin:]


def arrow_parts(batch: pa.RecordBatch, most: int, text: str = "body") -> Iterator[pa.RecordBatch]:
    """An Arrow batch in parts of about ``most`` bytes of text, without copies; a longer row comes alone."""
    part = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(begin, end - begin)


def map_in_parts(
    rows: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, most: int, text: str = "body",
) -> DataFrame:
    """``mapInPandas`` that turns about ``most`` bytes of text at a time into a frame, not a whole Arrow batch.

    Lists of structs become one Python object per field, so whole batches of them take many times their size.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (part.to_pandas() for batch in batches for part in arrow_parts(batch, most, text))
        for out in work(frames):
            yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

    return rows.mapInArrow(run, schema)
