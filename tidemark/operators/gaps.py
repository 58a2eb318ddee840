"""Largest gaps of distribution functions without ordering the rows.

Rows are counted in bins between a few edges of their group, in the tasks that read them; the edges are quantiles of some of the rows. A bin's counts bound what the gap
can be inside it, so only bins that may hold a larger gap than those at the edges are counted again in finer bins, and only the
rows of the bins that are left after that are ordered. The edges move work between the passes, never results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.plans.ordered import null_safe_join

BINS = 1_024  # of a group at first
ALL_BINS = 1 << 14  # of all groups at first
SPLIT = 64  # finer bins of a bin
ALL_SPLIT = 1 << 16  # finer bins of all groups
EDGE_ROWS = 1 << 20  # from which the first edges are taken
Parts = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]


class Cells:
    """Rows (g, w, value): number of the group and of the week, and a value that is not null."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def parts(self) -> Parts:
        """What gives, of a batch, each group's number with its weeks and values."""
        def split(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            group, week, value = (batch.column(c).to_numpy() for c in ("g", "w", "value"))
            for g in np.unique(group):
                own = group == g
                yield int(g), week[own], value[own]
        return split

    def quantiles(self, share: float, probs: list[float], accuracy: int) -> dict[int, list[float]]:
        some = self.rows if share >= 1 else self.rows.sample(share, 7)
        return {r["g"]: r["q"] for r in some.groupBy("g").agg(F.percentile_approx("value", probs, accuracy).alias("q")).collect()}


class ColumnCells(Cells):
    """Rows (week, a column for each group): a row is read once for all groups."""

    def __init__(self, rows: DataFrame, weeks: Sequence[int]):
        super().__init__(rows)
        self.weeks = np.array(weeks)

    def parts(self) -> Parts:
        weeks = self.weeks

        def split(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            week = np.searchsorted(weeks, batch.column(0).to_numpy())
            for g, column in enumerate(batch.columns[1:]):
                here = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else slice(None)
                yield g, week[here], column.drop_null().to_numpy()
        return split

    def quantiles(self, share: float, probs: list[float], accuracy: int) -> dict[int, list[float]]:
        some = self.rows if share >= 1 else self.rows.sample(share, 7)
        return dict(enumerate(some.agg(*[F.percentile_approx(c, probs, accuracy) for c in self.rows.columns[1:]]).first()))


class Bins:
    """Edges of numbered groups, one after the other: bin i of a group holds the values above edge i - 1 up to edge i, the last one the rest."""

    def __init__(self, edges: Sequence[np.ndarray]):
        self.edges = edges
        self.starts = np.cumsum([0, *[len(e) + 1 for e in edges]])  # a group's first bin
        self.low = np.concatenate([np.concatenate([[-np.inf], e]) for e in edges])
        self.high = np.concatenate([np.concatenate([e, [np.inf]]) for e in edges])
        self.last = np.zeros(len(self.low), bool)  # which also hold what is no number
        self.last[self.starts[1:] - 1] = True

    def place(self, group: int, value: np.ndarray) -> np.ndarray:
        return self.starts[group] + np.searchsorted(self.edges[group], value, side="left")

    def counts(self, cells: Cells, weeks: int) -> np.ndarray:
        """Rows of each bin (a line) and week."""
        parts = cells.parts()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(self.low) * weeks, np.int64)
            for batch in batches:
                for group, week, value in parts(batch):
                    first, end = self.starts[group] * weeks, self.starts[group + 1] * weeks
                    at = self.place(group, value) * weeks + week - first
                    if end - first > 8 * len(at):
                        place, times = np.unique(at, return_counts=True)
                        n[place + first] += times
                    else:
                        n[first:end] += np.bincount(at, minlength=end - first)
            found = np.nonzero(n)[0]
            yield pa.RecordBatch.from_pydict({"cell": found, "n": n[found]})
        out = np.zeros(len(self.low) * weeks, np.int64)
        summed = cells.rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()
        return out.reshape(-1, weeks)

    def below(self, counts: np.ndarray) -> np.ndarray:
        """Rows of the group before each bin."""
        upto = counts.cumsum(axis=0)
        return upto - counts - np.repeat((upto - counts)[self.starts[:-1]], np.diff(self.starts), axis=0)

    def judge(self, counts: np.ndarray, sizes: np.ndarray, ref: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest gap at an edge of each (group, week), and which bins may hold a larger one of some week."""
        before, groups = self.below(counts), len(self.edges)
        size = np.repeat(sizes, np.diff(self.starts), axis=0)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            low, high = before / size, (before + counts) / size
            at_edge = np.nan_to_num(np.abs(high - high[:, [ref]]), nan=0.0)
            best = np.stack([at_edge[a:b].max(axis=0) for a, b in zip(self.starts, self.starts[1:])]) if groups else np.zeros((0, counts.shape[1]))
            bound = np.nan_to_num(np.maximum(high - low[:, [ref]], high[:, [ref]] - low), nan=0.0)
            inside = (np.nextafter(self.low, np.inf) < self.high) | self.last
        bound[:, ref] = 0.0
        return best, inside & (bound > np.repeat(best, np.diff(self.starts), axis=0)).any(axis=1)

    def refined(self, open_: np.ndarray) -> "Bins":
        """The open bins cut evenly; the others stay."""
        parts, out = int(max(2, min(SPLIT, ALL_SPLIT // max(int(open_.sum()), 1)))), []
        for edges, a, b in zip(self.edges, self.starts, self.starts[1:]):
            own = np.nonzero(open_[a:b] & np.isfinite(self.low[a:b]) & np.isfinite(self.high[a:b]))[0] + a
            low, high = self.low[own, None], self.high[own, None]
            out.append(np.unique(np.concatenate([edges, np.clip(low + (high / parts - low / parts) * np.arange(1, parts), low, high).ravel()])))
        return Bins(out)


def _first_edges(cells: Cells, groups: int, total: int) -> Bins:
    bins = max(16, min(BINS, ALL_BINS // max(groups, 1)))
    found = cells.quantiles(EDGE_ROWS / max(total, 1), [i / bins for i in range(bins + 1)], 4 * bins)
    edges = []
    for g in range(groups):
        q = np.array(found.get(g) or [], float)
        q = q[~np.isnan(q)]
        heavy = q[1:][q[1:] == q[:-1]]  # alone in a bin
        edges.append(np.unique(np.concatenate([q, np.nextafter(heavy, -np.inf)])) + 0.0)
    return Bins(edges)


def largest_gaps(df: DataFrame, by: Sequence[str], week: str, value: str, cols: Sequence[str] = ()) -> DataFrame:
    """(by, week, n_ref, n_curr, d): the largest gap between the distribution functions of each later week and week 0, null where one has no value.

    A (group, week) of nulls only keeps its row. With ``cols`` the groups stand side by side in these columns of ``df`` (week, cols) and ``by``
    names the one column that holds their names. The driver holds a row per (group, week) and the counts of the bins; ``df`` is read a few
    times, so it should be a scan or a stored table.
    """
    by, spark = list(by), df.sparkSession
    kinds = dict(df.dtypes) | ({by[0]: "string"} if cols else {})
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"`{week}` {kinds[week]}", "n_ref long, n_curr long, d double"])
    there = df.filter(F.col(week).isNotNull())
    if cols:
        counted = there.groupBy(week).agg(*[F.count(c) for c in cols]).collect()
        seen = [(c, r[0], n) for r in counted for c, n in zip(cols, tuple(r)[1:])]
    else:
        seen = [tuple(r) for r in there.groupBy(*by, week).agg(F.count(value).alias("n")).collect()]
    groups, weeks = [(c,) for c in cols] or sorted({r[:-2] for r in seen}, key=repr), sorted({0} | {r[-2] for r in seen})
    if not seen:
        return spark.createDataFrame([], schema)
    at, number = {w: i for i, w in enumerate(weeks)}, {g: i for i, g in enumerate(groups)}
    sizes = np.zeros((len(groups), len(weeks)), np.int64)
    for r in seen:
        sizes[number[r[:-2]], at[r[-2]]] = r[-1]
    if cols:
        cells = ColumnCells(there.select(week, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]), weeks)
    else:
        numbered = spark.createDataFrame([(*g, i) for g, i in number.items()], ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "g int"]))
        coded = spark.createDataFrame(list(at.items()), f"`{week}` {kinds[week]}, w int")
        kept = df.select(*by, week, F.col(value).cast("double").alias("value")).filter(F.col("value").isNotNull())
        cells = Cells(null_safe_join(kept.join(F.broadcast(coded), week), F.broadcast(numbered), by).select("g", "w", "value"))
    ref, bins = at[0], _first_edges(cells, len(groups), int(sizes.sum()) // max(1, len(cols)))
    counts = bins.counts(cells, len(weeks))
    best, open_ = bins.judge(counts, sizes, ref)
    if open_.any():
        bins = bins.refined(open_)
        counts = bins.counts(cells, len(weeks))
        best, open_ = bins.judge(counts, sizes, ref)
    if open_.any():
        best = np.maximum(best, _ordered(cells, bins, open_, counts, sizes, ref))
    out = []
    for r in seen:
        g, w = number[r[:-2]], at[r[-2]]
        if r[-2] > 0:
            n, m = int(sizes[g, ref]), int(sizes[g, w])
            out.append((*groups[g], r[-2], n, m, float(best[g, w]) if n and m else None))
    return spark.createDataFrame(out, schema)


def _ordered(cells: Cells, bins: Bins, open_: np.ndarray, counts: np.ndarray, sizes: np.ndarray, ref: int) -> np.ndarray:
    """The largest gap of each (group, week) at the values within the open bins."""
    spark, weeks, parts = cells.rows.sparkSession, sizes.shape[1], cells.parts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, week, value in parts(batch):
                bin_ = bins.place(group, value)
                kept = open_[bin_]
                if kept.any():
                    yield pa.RecordBatch.from_pydict({"g": np.full(int(kept.sum()), group, np.int32), "bin": bin_[kept], "w": week[kept].astype(np.int32), "value": value[kept]})
    names = [f"c{i}" for i in range(weeks)]
    values = cells.rows.mapInArrow(run, "g int, bin long, w int, value double").groupBy("g", "bin", "value").agg(*[F.count_if(F.col("w") == i).alias(n) for i, n in enumerate(names)])
    upto = Window.partitionBy("g", "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    held = bins.below(counts)
    starts = spark.createDataFrame([(int(b), held[b].tolist()) for b in np.nonzero(open_)[0]], "bin long, before array<long>")
    totals = spark.createDataFrame([(g, line.tolist()) for g, line in enumerate(sizes)], "g int, size array<long>")
    placed = values.select("g", "bin", *[F.sum(n).over(upto).alias(n) for n in names]).join(F.broadcast(starts), "bin").join(F.broadcast(totals), "g")
    share = [F.try_divide(F.col(n) + F.get("before", F.lit(i)), F.get("size", F.lit(i))) for i, n in enumerate(names)]
    found = placed.groupBy("g").agg(*[F.max(F.abs(s - share[ref])).alias(n) for s, n in zip(share, names)]).collect()
    out = np.zeros(sizes.shape)
    for r in found:
        out[r["g"]] = [x or 0.0 for x in tuple(r)[1:]]
    return out
