"""Average ranks of many columns at once, and products of ranks over all rows.

The cells (row, column, value) are range-sorted by column, value and row, so a value that fills a third of a column is
spread over tasks like any other stretch of it. A task ranks its own stretch; how many cells lie before it and which ties
reach over its ends follow from one short row per (task, column). Cells then meet by row, and a task adds up the
products of whole rows as one matrix. Two exchanges, however many columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.plans.checkpoints import drop_stable, stable

FIRST, LAST = 1, 2  # of a task's ties of a column; their true extent shows only beside the neighbours
LONG = 4  # a tie that is handed on before its end; its rank is the number of cells of the column before it in the task
HELD = 65_536  # cells of an open tie that a task holds
CELLS = 1_000_000  # of a task
LOCAL = "row long, col int, part int, value double, rank double, edge int"


def _local_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Average ranks within a task's sorted stretch of each column; its first and last ties are marked.

    A tie of more than ``HELD`` cells is handed on as it comes, with its place instead of its rank; how long it is, and whether it is the first or
    the last, shows when its cells are counted.
    """
    part = TaskContext.get().partitionId()
    col, value, ids, done, sent = None, None, [], 0, 0  # the open tie, the cells of its column before it, and those of it already handed on

    def close(edge: int) -> pa.RecordBatch:
        rows = np.concatenate(ids)
        n = len(rows)
        if sent:
            return pa.RecordBatch.from_pydict({"row": rows, "col": np.full(n, col, np.int32), "part": np.full(n, part, np.int32), "value": np.full(n, value),
                                               "rank": np.full(n, float(done)), "edge": np.full(n, LONG, np.int32)})
        return pa.RecordBatch.from_pydict({"row": rows, "col": np.full(n, col, np.int32), "part": np.full(n, part, np.int32), "value": np.full(n, value),
                                           "rank": np.full(n, done + (n + 1) / 2), "edge": np.full(n, edge | (FIRST if done == 0 else 0), np.int32)})

    for batch in batches:
        rows, cols, values = (batch.column(c).to_numpy() for c in ("row", "col", "value"))
        if not len(rows):
            continue
        new = np.ones(len(rows), bool)
        same = (values[1:] == values[:-1]) | (np.isnan(values[1:]) & np.isnan(values[:-1]))
        new[1:] = (cols[1:] != cols[:-1]) | ~same
        start = 0
        if (ids or sent) and cols[0] == col and (values[0] == value or (np.isnan(value) and np.isnan(values[0]))):  # the open tie goes on
            start = int(np.argmax(new[1:]) + 1) if new[1:].any() else len(rows)
            ids.append(rows[:start])
            if sent + sum(map(len, ids)) > HELD:
                sent += sum(map(len, ids))
                yield close(LONG)
                ids = []
            if start == len(rows):
                continue
        if ids or sent:
            if ids:
                yield close(0 if cols[start] == col else LAST)
            done = done + sent + sum(map(len, ids)) if cols[start] == col else 0
            sent = 0
        starts = np.concatenate([[start], start + 1 + np.nonzero(new[start + 1:])[0]])
        sizes = np.diff(np.append(starts, len(rows)))
        whole = len(starts) - 1  # all ties but the last, which stays open
        if whole:
            first = np.searchsorted(cols[starts], cols[starts], "left")  # where the column's ties begin in this batch
            before = starts - starts[first] + np.where(cols[starts] == cols[start], done, 0)
            ends = cols[starts[1:]] != cols[starts[:-1]]
            edge = np.where(before[:whole] == 0, FIRST, 0) | np.where(ends, LAST, 0)
            rank = before[:whole] + (sizes[:whole] + 1) / 2
            stop = starts[whole]
            yield pa.RecordBatch.from_pydict({"row": rows[start:stop], "col": cols[start:stop], "part": np.full(stop - start, part, np.int32), "value": values[start:stop],
                                              "rank": np.repeat(rank, sizes[:whole]), "edge": np.repeat(edge, sizes[:whole]).astype(np.int32)})
            done = int(before[whole])
        col, value, ids = int(cols[starts[whole]]), float(values[starts[whole]]), [rows[starts[whole]:]]
    if ids:
        yield close(LAST)


@dataclass
class Stretch:
    """A task's cells of a column: their number, and value and size of the ties at its ends."""

    part: int
    n: int
    first: float
    n_first: int
    last: float
    n_last: int


def _same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b)


def place(stretches: Sequence[Stretch]) -> dict[int, tuple[float, float, float]]:
    """part -> (cells of the column before it, rank of its first tie, rank of its last tie), for one column in order."""
    out, before, run = {}, 0, []
    pieces = []  # (part, which end, value, cells before the piece, size), in order
    for s in stretches:
        pieces.append((s.part, 1, s.first, before, s.n_first))
        if s.n_first < s.n:
            pieces.append((s.part, 2, s.last, before + s.n - s.n_last, s.n_last))
        out[s.part] = [float(before), 0.0, 0.0]
        before += s.n
    for i, piece in enumerate(pieces):
        run.append(piece)
        after = pieces[i + 1] if i + 1 < len(pieces) else None
        if after is not None and _same(after[2], piece[2]):
            continue
        rank = run[0][3] + (sum(p[4] for p in run) + 1) / 2
        for part, end, *_ in run:
            out[part][end] = rank
        run = []
    return {part: tuple(x) for part, x in out.items()}


def rank_products(df: DataFrame, cols: Sequence[str], key: str | None = None) -> np.ndarray:
    """Products of centred average ranks summed over all rows, divided by the square of their number, as a matrix columns by columns.

    Missing values count as 0. ``key`` is a whole number that names a row; without it rows are numbered where they are read, so ``df``
    should be a scan or a stored table then. One row per (task, column) and per (task, long tie) and the matrix reach the driver.
    """
    k = len(cols)
    row = F.monotonically_increasing_id() if key is None else F.col(key).cast("long")
    rows = df.select(row.alias("row"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias("_cells"))
    cells = rows.select("row", F.posexplode("_cells").alias("col", "value"))
    # A task's share has a fixed size, so that neither its sort nor its ties grow with the table.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * k // CELLS))
    local = stable(cells.repartitionByRange(tasks, "col", "value", "row").sortWithinPartitions("col", "value", "row").mapInArrow(_local_ranks, LOCAL))
    first, last = F.col("edge").bitwiseAND(FIRST) > 0, F.col("edge").bitwiseAND(LAST) > 0
    ends = local.groupBy("col", "part").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(first, F.col("value"))).alias("first"), F.count_if(first).alias("n_first"),
                                            F.max(F.when(last, F.col("value"))).alias("last"), F.count_if(last).alias("n_last")).orderBy("col", "part").collect()
    ties = (local.filter(F.col("edge").bitwiseAND(LONG) > 0).groupBy("col", "part", "rank", "value").agg(F.count(F.lit(1)).alias("n"))
            .select("col", "part", F.col("rank").cast("long").alias("start"), "value", "n").collect())
    found = {(r["col"], r["part"]): Stretch(*r[1:]) for r in ends}
    for c, part, start, value, n in ties:
        stretch = found[c, part]
        if start == 0:
            stretch.first, stretch.n_first = value, n
        if start + n == stretch.n:
            stretch.last, stretch.n_last = value, n
    stretches = [[x for (own, _), x in found.items() if own == c] for c in range(k)]
    total = sum(s.n for s in stretches[0]) if k else 0
    if not total:
        return np.zeros((k, k))
    placed = {(c, part): x for c in range(k) for part, x in place(stretches[c]).items()}
    long_ranks = {}
    for c, part, start, _, n in ties:
        before, at_first, at_last = placed[c, part]
        long_ranks[c, part, start] = at_first if start == 0 else at_last if start + n == found[c, part].n else before + start + (n + 1) / 2

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rest = np.zeros((k, k)), np.empty(0)
        for batch in batches:
            col, part, rank, edge = (batch.column(c).to_numpy() for c in ("col", "part", "rank", "edge"))
            pairs, at = np.unique(np.stack([col, part]), axis=1, return_inverse=True)
            offset, at_first, at_last = np.array([placed[tuple(map(int, p))] for p in pairs.T]).reshape(-1, 3).T[:, at.ravel()]
            ranks = np.where(edge & FIRST, at_first, np.where(edge & LAST, at_last, offset + rank))
            long = edge & LONG > 0
            if long.any():
                which, back = np.unique(np.stack([col[long], part[long], rank[long].astype(np.int64)]), axis=1, return_inverse=True)
                ranks[long] = np.array([long_ranks[tuple(map(int, t))] for t in which.T])[back.ravel()]
            flat = np.concatenate([rest, (ranks - (total + 1) / 2) / total])
            whole = len(flat) // k * k
            x, rest = flat[:whole].reshape(-1, k), flat[whole:]
            out += x.T @ x
        yield pa.RecordBatch.from_pydict({"cell": np.arange(k * k, dtype=np.int32), "x": out.ravel()})
    meeting = local.select("row", "col", "part", "rank", "edge").repartition(tasks, "row").sortWithinPartitions("row", "col").drop("row")
    sums = meeting.mapInArrow(products, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).orderBy("cell").collect()
    drop_stable(local)
    return np.array([r["x"] for r in sums]).reshape(k, k)
