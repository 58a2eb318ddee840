"""Input size estimates taken from the optimised plan, without running a job."""

from __future__ import annotations

from pyspark.sql import DataFrame

CHUNK_BYTES_KEY = "spark.tidemark.chunkBytes"
CHUNKS_KEY = "spark.tidemark.chunks"  # a fixed number for every scan, for tests
DEFAULT_CHUNK_BYTES = 64 << 20
UNKNOWN = 1 << 62


def input_bytes(df: DataFrame) -> int:
    """Sum of the leaf relations' sizes; ``UNKNOWN`` when a leaf has no estimate.

    Leaves are summed because the estimate of a join without column statistics is the product of its
    sides, which says nothing about the work.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        size = int(str(leaves.apply(i).stats().sizeInBytes()))
        if size >= UNKNOWN:
            return UNKNOWN
        total += size
    return total


def chunk_count(df: DataFrame) -> int:
    """How many ordered chunks a scan over ``df`` is cut into, one at least. It moves work between tasks, never results."""
    conf = df.sparkSession.conf
    fixed = conf.get(CHUNKS_KEY, None)
    if fixed is not None:
        return max(1, int(fixed))
    size = input_bytes(df)
    if size >= UNKNOWN:
        return int(conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // int(conf.get(CHUNK_BYTES_KEY, str(DEFAULT_CHUNK_BYTES)))))
