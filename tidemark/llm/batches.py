"""Arrow batches in Python tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

SLICE_BYTES = 16 << 20


def load(spark, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names; whatever else the table holds can't clash with them."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds ``limit`` bytes or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def rows(**columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def give_back() -> None:
    """Returns freed memory to the system: an idle worker process would otherwise keep a task's peak beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task function that gives its memory back when it ends."""
    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return task
