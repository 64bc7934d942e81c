"""Shared helpers: reading tables, walking Arrow batches in bounded slices."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; one longer text is a slice of its own.
SLICE_BYTES = 1 << 22


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def give_back() -> None:
    """Return freed memory to the system: Spark keeps its workers, and what one stage leaves with the allocators
    counts in the next."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library has it
        trim(0)


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each with about ``size`` bytes of text or one row; what a part needed is given
    back to the system after the batch."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()
