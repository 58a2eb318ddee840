"""Exact top-k inner products of integer vectors.

All vectors are sorted by descending length and cut into blocks, the queries into blocks of their own. The block of the
longest vectors gives each query a first k-th score; after that a block only meets the query blocks for which length times
length can still reach it. Where two blocks meet, the components rotated by the singular vectors give partial sums over
the leading half; with the lengths of what is left (Cauchy-Schwarz) they bound each score from above, and only pairs
whose bound reaches the query's k-th score get their exact integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.batches import only, released
from tidemark.llm.vectors import by_id, matrix, rotation, usable, width
from tidemark.plans.checkpoints import stable

BLOCK = 8_192
QUERY_BLOCK = 1_024
EXACT = 2.0 ** 53
TASKS_PER_CORE = 8
BLOCK_TYPE = "block long, longest double, ids binary, parts binary"


def _blocks(df: DataFrame, dim: int, size: int) -> DataFrame:
    """(block, longest, ids, parts) of at most ``size`` rows each, in the order of the input's partitions; ids rise within a block."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, count = TaskContext.get().partitionId() << 32, [], 0

        def block(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("id").to_numpy()
            order = np.argsort(ids)
            parts = batch.column("v").flatten().to_numpy().reshape(-1, dim)[order]
            longest = float(np.sqrt((parts.astype(float) ** 2).sum(axis=1).max()))
            bound = -batch.column("bound").to_numpy()[order]
            return pa.RecordBatch.from_pydict({"block": [first], "longest": [longest], "ids": pa.array([ids[order].tobytes()], pa.binary()),
                                               "parts": pa.array([parts.tobytes() + bound.tobytes()], pa.binary())})

        def merged() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, size - count)
                held.append(take)
                count += take.num_rows
                batch = batch.slice(take.num_rows)
                if count == size:
                    yield block(merged())
                    first, held, count = first + 1, [], 0
        if count:
            yield block(merged())
    return df.mapInArrow(run, BLOCK_TYPE)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles hold them exactly while they are below 2**53, Python's integers do beyond."""
    reach = np.sqrt((left.astype(float) ** 2).sum(axis=1).max() * (right.astype(float) ** 2).sum(axis=1).max())
    if reach < EXACT / 2:
        return left.astype(float) @ right.astype(float).T
    exact = left.astype(object) @ right.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest scores, the leftmost (smallest id) first among equals."""
    rows, columns = [], []
    n = scores.shape[1]
    cut = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    for i, least in enumerate(cut):
        above = np.nonzero(scores[i] > least)[0]
        level = np.nonzero(scores[i] == least)[0][:k - len(above)] if least > -np.inf else above[:0]
        found = np.concatenate([above, level])
        rows.append(np.full(len(found), i))
        columns.append(found)
    return np.concatenate(rows), np.concatenate(columns)


def _meet(pairs: DataFrame, dim: int, k: int, turn: np.ndarray) -> DataFrame:
    lead = max(1, dim // 2)

    def unpack(ids: bytes, parts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(ids, np.int64)
        return ids, np.frombuffer(parts, np.int64, len(ids) * dim).reshape(-1, dim), np.frombuffer(parts, np.float64, len(ids), 8 * len(ids) * dim)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_parts, c_ids, c_parts in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_parts", "ids", "parts"))):
                q_id, q, reach = unpack(q_ids, q_parts)
                c_id, c, _ = unpack(c_ids, c_parts)
                qr, cr = q @ turn, c @ turn
                rest = np.outer(np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(cr[:, lead:], axis=1))
                bound = qr[:, :lead] @ cr[:, :lead].T + rest
                alive = bound * (1 + 1e-9) + 1e-3 + np.abs(bound) * 1e-9 >= reach[:, None]
                some = np.nonzero(alive.any(axis=0))[0]  # vectors that some query still needs
                if not len(some):
                    continue
                exact = _products(q, c[some])
                scores = np.where(alive[:, some], exact.astype(float), -np.inf)
                at = np.searchsorted(c_id[some], q_id)
                own = np.nonzero((at < len(some)) & (c_id[some][np.minimum(at, len(some) - 1)] == q_id))[0]
                scores[own, at[own]] = -np.inf
                rows, columns = _best(scores, c_id[some], k)
                yield pa.RecordBatch.from_pydict({"query_id": q_id[rows], "vec_id": c_id[some][columns],
                                                  "score": pa.array([int(s) for s in exact[rows, columns]], pa.int64())})
    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def top_k(table: DataFrame, is_query: Column, k: int, *, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products of floor(scale * x) with other rows, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``. Null and unusable vectors and null ids take no part; of rows that repeat an id the
    least vector counts; shorter vectors are filled with zeros; a query with fewer candidates has fewer rows, an empty table none. Scores are
    limited to 64 bits. Whole blocks meet in tasks; no task holds more than one block of each side, and each gives ``k`` rows a query at most.
    """
    clean = only(table, id=vec_id, v=vector).filter(usable(F.col("v")) & F.col("id").isNotNull()).withColumn("id", F.col("id").cast("long"))
    dim = width(clean)
    ints = stable(by_id(clean, dim).select("id", F.transform("v", lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v")))
    turn, _ = rotation(ints, dim)
    count = ints.count()
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sorted_ = (ints.select("id", "v", (-length).alias("bound")).repartitionByRange(max(1, -(-count // BLOCK)), "bound", "id").sortWithinPartitions("bound", "id"))
    blocks = stable(_blocks(sorted_, dim, BLOCK)) if dim else None
    if blocks is None or not blocks.take(1):
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = ints.filter(is_query)
    parts = max(1, -(-count // (20 * QUERY_BLOCK)))

    def queries(reach: DataFrame | None) -> DataFrame:
        """Query blocks with the score that each query must reach, kept negative in ``bound``."""
        least = asked.select("id", "v", F.lit(float("inf")).alias("bound")) if reach is None else (
            asked.join(reach, "id", "left").select("id", "v", F.coalesce(-F.col("least").cast("double"), F.lit(float("inf"))).alias("bound")))
        packed = _blocks(least.repartition(parts, "id"), dim, QUERY_BLOCK)
        return packed.select(F.col("block").alias("q_block"), F.col("longest").alias("q_longest"), F.col("ids").alias("q_ids"), F.col("parts").alias("q_parts"))

    longest = blocks.agg(F.max_by("block", F.struct("longest", "block"))).first()[0]
    first = stable(_top(_meet(queries(None).crossJoin(blocks.filter(F.col("block") == longest)).repartition(parts, "q_block"), dim, k, turn), k))
    reach = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    again = stable(queries(reach))
    need = reach.agg(F.min("least")).first()[0]
    floor = float("-inf") if need is None or asked.count() > reach.count() else float(need)
    keys = again.select("q_block", "q_longest").crossJoin(blocks.filter(F.col("block") != longest).select("block", "longest"))
    open_ = keys.filter(F.col("q_longest") * F.col("longest") * (1 + 1e-9) + 1e-3 >= floor).select("q_block", "block")
    tasks = max(1, min(parts * -(-count // BLOCK), TASKS_PER_CORE * table.sparkSession.sparkContext.defaultParallelism))
    pairs = open_.repartition(tasks, "q_block", "block").join(again, "q_block").join(blocks, "block")
    return _top(first.drop("rank").unionByName(_meet(pairs, dim, k, turn)), k).withColumn("rank", F.col("rank").cast("int"))


SQL = """
WITH e AS (SELECT vec_id, min(embedding) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
 i AS (SELECT vec_id, list_transform(v, lambda x: floor(64 * x::DOUBLE)) AS v FROM e),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM i q JOIN i c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
