"""Two-sample statistics of many pairs of samples of the same rows at once: every (reference week, later week), every random split.

How often a value occurs in each sample is one vector per (group, value), so a row is counted once, however many samples
it belongs to. The vectors are range-sorted and added up; a sample is a whole-number combination of them (all weeks through
one, all rows without a part), so its cumulative counts are one matrix product. From then on no order is needed: the
largest gap of two distribution functions is a maximum over rows, the value at a position the least value whose cumulative
count is above it, and the count below a bin edge the largest cumulative count of a smaller value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.cumulative import Grouped, summed
from tidemark.plans.checkpoints import drop_stable, stable
from tidemark.plans.ordered import null_safe_join
from tidemark.plans.sizing import CHUNKS_KEY


@dataclass(frozen=True)
class Pair:
    """Values of the label columns, and how often each sample's counts enter the reference and the window."""

    labels: tuple
    ref: tuple[int, ...]
    curr: tuple[int, ...]


def value_vectors(df: DataFrame, by: Sequence[str], value: str, samples: Sequence[Column]) -> DataFrame:
    """(by, value, counts): the non-null rows of each sample (a condition) by value; combined in the map tasks."""
    kept = df.filter(F.col(value).isNotNull())
    return kept.groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.array(*[F.count_if(s) for s in samples]).alias("counts"))


class Sums:
    """Stored running sums of the vectors of numbered groups; ``combine`` (samples x forms) makes the cumulative counts of every form."""

    def __init__(self, vectors: DataFrame, count: int, combine: np.ndarray, chunks: int | None):
        fixed = vectors.sparkSession.conf.get(CHUNKS_KEY, None) if chunks is None else chunks
        into = [] if fixed is None else [int(fixed)]
        sorted_ = vectors.repartitionByRange(*into, "g", "value").sortWithinPartitions("g", "value")
        self.rows, width = stable(sorted_.mapInArrow(summed, "g int, part int, value double, upto array<long>")), combine.shape[0]
        ends = self.rows.groupBy("g", "part").agg(F.array(*[F.max(F.get("upto", F.lit(i))) for i in range(width)]).alias("s")).orderBy("g", "part").collect()
        total = np.zeros((count, width), np.int64)
        before = {}
        for r in ends:
            before[r["g"], r["part"]] = total[r["g"]].copy()
            total[r["g"]] += np.array(r["s"], np.int64)
        self.sizes = total @ combine  # rows of every form, a line a group
        self.grouped = Grouped(before, combine)

    def greatest(self, start: np.ndarray, update) -> np.ndarray:
        """The greatest of each cell of ``start`` (a line a group) that ``update(cells, group, values, cumulative)`` finds anywhere; tasks hand on the groups they saw."""
        grouped = self.grouped

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, np.ndarray] = {}
            for g, values, cumulative in grouped(batches):
                update(best.setdefault(g, start[g].copy()), g, values, cumulative)
            for g, cells in best.items():
                yield pa.RecordBatch.from_pydict({"g": np.full(cells.size, g, np.int32), "cell": np.arange(cells.size, dtype=np.int32), "x": cells.ravel()})
        found = self.rows.mapInArrow(run, "g int, cell int, x double").groupBy("g", "cell").agg(F.max("x").alias("x")).collect()
        out = start.copy()
        for r in found:
            out[r["g"]].ravel()[r["cell"]] = r["x"]
        return out


CELLS = ("n_ref long, n_curr long, d double, n_edges int, ref_counts array<long>, curr_counts array<long>, lo double, hi double, step double, joint_ref array<long>, "
         "joint_curr array<long>, ref_lo double, ref_hi double, curr_lo double, curr_hi double")


class Profile:
    """Everything that the statistics need of each (group, pair): the KS gap, bin counts and ends of both samples, in one row of ``table``.

    ``buckets`` asks for bins at the reference's quantiles, ``bins`` for equal-width ones over the joint range; either may be None.
    ``groups`` are the values of the columns ``by``, ``labels`` the pairs' label columns with their types, the last of which stands where
    a statistic has its window. The driver holds a row per (group, pair) and a vector per (task, group).
    """

    def __init__(self, vectors: DataFrame, by: Sequence[str], groups: Sequence[tuple], pairs: Sequence[Pair], labels: Sequence[tuple[str, str]],
                 buckets: int | None = 10, bins: int | None = 20, chunks: int | None = None, keep=None):
        self.buckets, self.bins, self.week = buckets, bins, labels[-1][0]
        self.by = [*by, *[n for n, _ in labels[:-1]]]
        spark = vectors.sparkSession
        kinds = [f"`{c}` {dict(vectors.dtypes)[c]}" for c in by]
        schema = ", ".join([*kinds, *[f"`{n}` {t}" for n, t in labels], CELLS])
        if not groups or not pairs:
            self.table = spark.createDataFrame([], schema)
            return
        numbered = spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], ", ".join([*kinds, "g int"]))
        coded = null_safe_join(vectors, F.broadcast(numbered), list(by)).select("g", "value", "counts")
        forms = sorted({p.ref for p in pairs} | {p.curr for p in pairs})
        at = {f: i for i, f in enumerate(forms)}
        ref, curr = (np.array([at[x] for x in side], int) for side in ([p.ref for p in pairs], [p.curr for p in pairs]))
        sums = Sums(coded, len(groups), np.array(forms, np.int64).T, chunks)
        sizes, n_bins, n_inner = sums.sizes, bins or 1, (buckets or 1) - 1
        probs = np.arange(n_inner + 2) / (n_inner + 1)
        h = probs * (sizes[:, :, None] - 1)
        places = np.concatenate([np.floor(h), np.ceil(h)], axis=2)  # wanted positions of every (group, form); the ends are among them
        n_places = places.shape[2]

        def gaps(cells: np.ndarray, g: int, values: np.ndarray, cumulative: np.ndarray) -> None:
            with np.errstate(divide="ignore", invalid="ignore"):
                share = cumulative / sizes[g]
                np.fmax(cells[:len(ref)], np.abs(share[:, curr] - share[:, ref]).max(axis=0), out=cells[:len(ref)])
            low = cells[len(ref):].reshape(len(forms), n_places)  # least values, kept negative
            for i in range(len(forms)):
                where = np.searchsorted(cumulative[:, i], places[g, i], side="right")
                inside = (where < len(values)) & (places[g, i] >= 0)
                low[i, inside] = np.maximum(low[i, inside], -values[where[inside]])

        found = sums.greatest(np.full((len(groups), len(ref) + len(forms) * n_places), -np.inf), gaps)
        d, low = found[:, :len(ref)], -found[:, len(ref):].reshape(len(groups), len(forms), 2, -1)
        ticks = np.full((len(groups), len(pairs), n_inner + n_bins - 1), -np.inf)  # below no value, so a tick that isn't there counts 0
        edges: dict[tuple[int, int], list[float]] = {}
        for g in range(len(groups)):
            for i in set(ref.tolist()) if buckets else ():
                if sizes[g, i] > 0:
                    edges[g, i] = list(dict.fromkeys((low[g, i, 0] + (low[g, i, 1] - low[g, i, 0]) * (h[g, i] - np.floor(h[g, i]))).tolist()))
            for p, (r, c) in enumerate(zip(ref, curr)):
                inner = edges.get((g, r), [])[1:-1]
                ticks[g, p, :len(inner)] = inner
                if sizes[g, r] > 0 and sizes[g, c] > 0:
                    first, last = min(low[g, r, 0, 0], low[g, c, 0, 0]), max(low[g, r, 0, -1], low[g, c, 0, -1])
                    ticks[g, p, n_inner:] = first + np.arange(1, n_bins) * ((last - first) / n_bins)

        def below(cells: np.ndarray, g: int, values: np.ndarray, cumulative: np.ndarray) -> None:
            where = np.searchsorted(values, ticks[g].ravel(), side="left").reshape(ticks[g].shape) - 1
            for side, forms_ in zip(cells.reshape(2, *ticks[g].shape), (ref, curr)):
                np.maximum(side, np.where(where >= 0, cumulative[np.maximum(where, 0), forms_[:, None]], 0), out=side)

        counted = np.zeros((len(groups), 2 * ticks[0].size))
        if ticks.shape[2]:
            counted = sums.greatest(counted, below)
        drop_stable(sums.rows)
        sides = counted.astype(np.int64).reshape(len(groups), 2, *ticks.shape[1:])
        rows = []
        for g, group in enumerate(groups):
            for p, pair in enumerate(pairs):
                if keep is not None and not keep(group, pair.labels):
                    continue
                own, both = edges.get((g, ref[p]), []), [(side[p], int(sizes[g, f])) for side, f in zip(sides[g], (ref[p], curr[p]))]
                ends = [None if not n else float(low[g, f, 0, e]) for (_, n), f in zip(both, (ref[p], curr[p])) for e in (0, -1)]
                whole = both[0][1] > 0 and both[1][1] > 0
                quantile = [np.diff([0, *side[:len(own) - 2], n]).tolist() if len(own) > 1 else [] for side, n in both]
                joint = [np.diff([0, *side[n_inner:], n]).tolist() if whole and bins else [] for side, n in both]
                lo, hi = (min(ends[0], ends[2]), max(ends[1], ends[3])) if whole else (None, None)
                rows.append((*group, *pair.labels, both[0][1], both[1][1], float(d[g, p]) if whole else None, len(own) or None, *quantile,
                             lo, hi, (hi - lo) / bins if whole and bins else None, *joint, *ends))
        self.table = spark.createDataFrame(rows, schema)


def week_profile(df: DataFrame, by: Sequence[str] = ("feature",), week: str = "week", value: str = "value", buckets: int | None = 10, bins: int | None = 20,
                 ref_weeks: Sequence[int] | None = None, chunks: int | None = None) -> Profile:
    """Every later week of a long table against week 0; with ``ref_weeks`` every (reference week, later week), the reference being all weeks
    through it. Two scans of ``df``: which (group, week) there are, and the values. A (group, week) of nulls only keeps its row."""
    present = [tuple(r) for r in df.select(*by, week).filter(F.col(week).isNotNull()).distinct().collect()]
    groups, weeks, seen = sorted({r[:-1] for r in present}, key=repr), sorted({r[-1] for r in present}), set(present)
    one = lambda test: tuple(int(test(x)) for x in weeks)
    if ref_weeks is None:
        pairs = [Pair((w,), one(lambda x: x == 0), one(lambda x: x == w)) for w in weeks if w > 0]
        labels = [(week, dict(df.dtypes)[week])]
    else:
        pairs = [Pair((r, w), one(lambda x: x <= r), one(lambda x: x == w)) for r in ref_weeks for w in weeks if w > r]
        labels = [("ref_week", "long"), (week, dict(df.dtypes)[week])]
    vectors = value_vectors(df, by, value, [F.col(week) == w for w in weeks] or [F.lit(False)])
    return Profile(vectors, by, groups, pairs, labels, buckets, bins, chunks, lambda group, label: (*group, label[-1]) in seen)
