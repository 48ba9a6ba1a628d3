"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, with a missing one taken as empty."""
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text, none for a missing one."""
    return whole_text(text).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a binary column holds about ``size`` bytes in each, one row at least.

    After each batch Arrow hands the memory back that it holds for later, so that a worker does not grow with its tasks.
    """
    for batch in batches:
        held, start = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            if held + (n or 0) > size and i > start:
                yield batch.slice(start, i - start)
                held, start = 0, i
            held += n or 0
        yield batch.slice(start)
        del batch
        pa.default_memory_pool().release_unused()
