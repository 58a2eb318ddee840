"""Cumulative counts in Python tasks. Light on imports, as every worker loads it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of the vectors within a task's stretch of each group."""
    from pyspark import TaskContext
    part, group, carried = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column("g").to_numpy()
        counts = batch.column("counts").flatten().to_numpy().reshape(batch.num_rows, -1)
        cuts = [0, *(np.nonzero(groups[1:] != groups[:-1])[0] + 1), len(groups)]
        sums = np.empty_like(counts)
        for a, b in zip(cuts, cuts[1:]):
            sums[a:b] = counts[a:b].cumsum(axis=0) + (carried if groups[a] == group else 0)
            group, carried = groups[a], sums[b - 1].copy()
        offsets = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"g": groups, "part": np.full(len(groups), part, np.int32), "value": batch.column("value"), "upto": pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))})


class Grouped:
    """Rows (g, part, value, upto) of stored running sums, with the vector before each (group, task) and the combinations that are wanted."""

    def __init__(self, before: dict[tuple[int, int], np.ndarray], combine: np.ndarray):
        self.before, self.combine = before, combine

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(group, values in order, cumulative counts of every form) of each batch."""
        for batch in batches:
            owner, parts, values = (batch.column(c).to_numpy() for c in ("g", "part", "value"))
            upto = batch.column("upto").flatten().to_numpy().reshape(len(values), -1)
            for g in np.unique(owner):
                own = np.nonzero(owner == g)[0]
                own = own[np.argsort(values[own], kind="stable")]
                found, back = np.unique(parts[own], return_inverse=True)
                yield int(g), values[own], (upto[own] + np.stack([self.before[int(g), int(p)] for p in found])[back.ravel()]) @ self.combine
