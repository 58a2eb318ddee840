"""Vector columns as matrices in Python tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS = 20_000


def usable(vector: Column) -> Column:
    """Not null, not empty, and no component null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def by_id(df: DataFrame, dim: int) -> DataFrame:
    """(id, v): one row per id (of rows that repeat an id the least vector), shorter vectors filled with zeros to ``dim``."""
    filled = F.concat("v", F.array_repeat(F.lit(0).cast(df.schema["v"].dataType.elementType), F.lit(dim) - F.size("v")))
    return df.groupBy("id").agg(F.min("v").alias("v")).select("id", filled.alias("v"))


def width(df: DataFrame) -> int:
    return df.agg(F.max(F.size("v"))).first()[0] or 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), dim)


def rotation(df: DataFrame, dim: int, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors as columns, in falling order of their singular values, and a sample's rotated rows.

    Fitted on at most ``rows`` rows, those with the smallest hash of the id. It steers how much is pruned, never what is found.
    """
    few = df.select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(rows).select("v").toArrow().column("v").combine_chunks()
    sample = matrix(few, dim)
    if not len(sample):
        return np.eye(dim), sample
    _, vectors = np.linalg.eigh(sample.T @ sample)  # the right singular vectors, without the left ones
    turn = np.ascontiguousarray(vectors[:, ::-1])
    return turn, sample @ turn
