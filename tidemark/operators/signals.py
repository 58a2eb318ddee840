"""Drift signals of every (reference week, later week); the reference of a pair is all weeks through its reference week.

What a reference needs of its rows adds up over weeks: counts, sums and products of columns are taken once per week, and sums over
the weeks through each reference week give its scale and its principal components. K-means of all references is one job
a round, in which a row moves the centres of every reference that holds it. Value distributions of all pairs come
from one ``week_profile``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numeric import EPSILON
from tidemark.operators.distribution import benjamini_hochberg, feature_signal_summary, js_distance, ks_test, psi_null
from tidemark.operators.profiles import Profile, week_profile
from tidemark.operators.sampling import bounded_sample
from tidemark.operators.structure import SPREAD_FLOOR, attribution_drift, attribution_summary
from tidemark.operators.windows import to_long
from tidemark.plans.checkpoints import drop_stable, stable
from tidemark.plans.pool import run_pool

SIGNALS = ("ks_drift_fraction", "ks_mean_statistic", "psi_drift_fraction", "psi_mean_ratio", "js_mean_distance", "attribution_drift_fraction",
           "attribution_mean_shift", "cluster_distance_ratio", "cluster_psi", "autoencoder_z_score", "weeks_since_reference")
SEED_ROWS = 5_000  # rows from which first centres are drawn
Z_LIMIT = 10.0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Weeks in order and the rows, each column in one piece: the rows through a week are the first ones, without a copy."""
    for batch in batches:
        if batch.num_rows:
            weeks, x = batch.column("week").to_numpy(), batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            order = np.argsort(weeks, kind="stable")
            yield weeks[order], np.asfortranarray(x[order])


def _added(rows: DataFrame, shape: tuple[int, ...], update: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """What ``update(cells, weeks, x)`` adds to an array of ``shape``, over all rows; a task hands on one array."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(shape)
        for weeks, x in _blocks(batches):
            update(cells, weeks, x)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(size, dtype=np.int32), "v": cells.ravel()})
    out = np.zeros(size)
    for r in rows.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).filter("v <> 0").collect():
        out[r["cell"]] = r["v"]
    return out.reshape(shape)


@dataclass
class Reference:
    """What is fitted on the weeks through ``week``: scale, projection on the leading components, cluster centres."""

    week: int
    mean: np.ndarray
    std: np.ndarray
    projector: np.ndarray
    centres: np.ndarray | None = None

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std


def vectors_of(matrix: DataFrame, cols: Sequence[str], week: str = "week") -> DataFrame:
    """(week, x): the columns as one array, missing as 0."""
    return matrix.select(F.col(week).cast("long").alias("week"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias("x"))


def references(rows: DataFrame, ref_weeks: Sequence[int], weeks: Sequence[int], k: int) -> list[Reference]:
    """Scale and projection of every reference week from one pass over (week, x)."""
    at, first = {w: i for i, w in enumerate(weeks)}, rows.first()
    shift = np.array(first["x"]) if first is not None else np.zeros(k)  # moments about some row keep their digits

    def update(cells: np.ndarray, own: np.ndarray, x: np.ndarray) -> None:
        with_one = np.concatenate([np.ones((len(x), 1)), x - shift], axis=1)
        for w in np.unique(own):
            some = with_one[own == w]
            cells[at[int(w)]] += some.T @ some
    moments = _added(rows, (len(weeks), k + 1, k + 1), update).cumsum(axis=0)
    out = []
    for r in ref_weeks:
        m = moments[at[r]]
        n = max(m[0, 0], 1.0)
        mean = m[0, 1:] / n
        spread = m[1:, 1:] / n - np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(spread), 0))
        std = np.where(std >= SPREAD_FLOOR, std, 1.0)
        _, parts = np.linalg.eigh(spread / np.outer(std, std))
        lead = parts[:, ::-1][:, :min(k, max(2, k // 2))]
        out.append(Reference(r, mean + shift, std, lead @ lead.T))
    return out


def _spread_seeds(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """First centres: each next one drawn with the squared distance to the nearest so far."""
    rnd, chosen = np.random.default_rng(seed), []
    if not len(x):
        return np.zeros((k, x.shape[1]))
    far = np.ones(len(x))
    for _ in range(k):
        chosen.append(x[rnd.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[0])
        far = ((x[:, None, :] - np.array(chosen)[None, :, :]) ** 2).sum(axis=2).min(axis=1)
    return np.array(chosen)


def _nearest(z: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the distance to it, the first of equals."""
    columns, near, least = np.ascontiguousarray(z.T), np.zeros(len(z), np.int64), np.full(len(z), np.inf)
    for i, centre in enumerate(centres):
        d = np.zeros(len(z))
        for x, c in zip(columns, centre):
            gap = x - c
            gap *= gap
            d += gap
        near = np.where(d < least, i, near)
        least = np.minimum(d, least)  # what is no number stays none
    return near, np.sqrt(least)


def fit_centres(rows: DataFrame, refs: list[Reference], sample: tuple[np.ndarray, np.ndarray], k: int = 5, seed: int = 42, rounds: int = 20, tolerance: float = 1e-4) -> None:
    """K-means on the scaled rows of every reference, all at once: a job a round until no centre moves by more than ``tolerance``."""
    weeks, x = sample
    for r in refs:
        r.centres = _spread_seeds(r.scaled(x[weeks <= r.week]), k, seed)
    moving = list(range(len(refs)))
    for _ in range(rounds):
        if not moving:
            break
        now = [refs[i] for i in moving]

        def update(cells: np.ndarray, own: np.ndarray, x: np.ndarray) -> None:
            for i, r in enumerate(now):
                z = r.scaled(x[:np.searchsorted(own, r.week, side="right")])
                if len(z):
                    near, _ = _nearest(z, r.centres)
                    cells[i] += np.stack([np.bincount(near, column, k) for column in (None, *z.T)], axis=1)
        sums, still = _added(rows, (len(now), k, x.shape[1] + 1), update), []
        for i, r, s in zip(moving, now, sums):
            moved = np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1.0), r.centres)
            if np.sqrt(((moved - r.centres) ** 2).sum(axis=1)).max() > tolerance:
                still.append(i)
            r.centres = moved
        moving = still


def structure_signals(rows: DataFrame, refs: list[Reference], weeks: Sequence[int], k: int = 5) -> DataFrame:
    """(ref_week, week, cluster_distance_ratio, cluster_psi, autoencoder_z_score) of every pair, from one pass over (week, x)."""
    at = {w: i for i, w in enumerate(weeks)}

    def update(cells: np.ndarray, own: np.ndarray, x: np.ndarray) -> None:
        for i, r in enumerate(refs):
            z = r.scaled(x)
            near, distance = _nearest(z, r.centres)
            rmse = np.sqrt(((z - z @ r.projector) ** 2).mean(axis=1))
            each = np.concatenate([np.stack([np.ones(len(z)), distance, rmse, rmse ** 2], axis=1), (near[:, None] == np.arange(k)).astype(float)], axis=1)
            seen, starts = np.unique(own, return_index=True)
            cells[i, [at[int(w)] for w in seen]] += np.add.reduceat(each, starts, axis=0)
    sums, out = _added(rows, (len(refs), len(weeks), 4 + k), update), []
    for i, r in enumerate(refs):
        held = sums[i, [at[w] for w in weeks if w <= r.week]].sum(axis=0)
        n = max(held[0], 1.0)
        deviation = np.sqrt(max(held[3] / n - (held[2] / n) ** 2, 0.0))
        share = lambda s, size: np.where(s == 0, EPSILON, s / size)
        for w in weeks:
            if w > r.week and (s := sums[i, at[w]])[0]:
                p, q = share(s[4:], s[0]), share(held[4:], n)
                z = (s[2] / s[0] - held[2] / n) / max(deviation, 1e-6)
                out.append((r.week, w, float(s[1] / s[0] / max(held[1] / n, 1e-6)), float(((p - q) * np.log(p / q)).sum()), float(np.clip(z, -Z_LIMIT, Z_LIMIT))))
    return rows.sparkSession.createDataFrame(out, "ref_week long, week long, cluster_distance_ratio double, cluster_psi double, autoencoder_z_score double")


def pair_statistics(profile: Profile, n_boot: int = 15, seed: int = 42) -> DataFrame:
    """(feature, ref_week, week) with KS, PSI and JS of each pair; KS is corrected over the features of a pair."""
    pair = ["ref_week", "week"]
    ks = benjamini_hochberg(ks_test(profile), pair).select("feature", *pair, F.col("statistic").alias("ks_statistic"), (F.col("rejected") & (F.col("statistic") >= 0.10)).alias("ks_drift"))
    null = psi_null(profile, n_boot=n_boot, seed=seed).select("feature", *pair, "psi", "psi_ratio", F.col("drift").alias("psi_drift"))
    return ks.join(null, ["feature", *pair]).join(js_distance(profile).select("feature", *pair, "js_distance"), ["feature", *pair])


def signal_matrix(matrix: DataFrame, cols: Sequence[str], ref_weeks: Sequence[int], attribute: Callable[[int], DataFrame], key: str, n_boot: int = 15, k: int = 5,
                  seed: int = 42, pool: int | None = None, head: str | None = None) -> DataFrame:
    """(ref_week, week, the eleven signals) of every reference week and later week of ``matrix`` (key, week, cols).

    ``attribute(ref_week)`` gives the attributions of the model that was fitted through that week, long (week, feature, attribution) or side by side
    (week, cols); these models are the only thing done once per reference week, a few at a time; their attributions are stored, judged and dropped
    one after another. Numbers of week pairs x features reach the driver. ``head`` is that of ``digest_cuts``.
    """
    weeks = sorted(r[0] for r in matrix.select("week").distinct().collect())
    ref_weeks = [r for r in ref_weeks if r in weeks]
    profile = week_profile(to_long(matrix, [key, "week"], cols), ref_weeks=ref_weeks)
    summary = feature_signal_summary(pair_statistics(profile, n_boot, seed), ["ref_week", "week"])
    rows = vectors_of(matrix, cols)
    refs = references(rows, ref_weeks, weeks, len(cols))
    seeds = vectors_of(bounded_sample(matrix, SEED_ROWS, key, seed, head=head), cols).toArrow().sort_by("week")
    found = list(_blocks(iter(seeds.combine_chunks().to_batches())))
    fit_centres(rows, refs, found[0] if found else (np.empty(0), np.empty((0, len(cols)))), k, seed)
    near = structure_signals(rows, refs, weeks, k)
    since = lambda r: F.greatest(F.lit(0), F.col("week") - r).cast("long").alias("week")
    shift = None
    for r, rows_of in zip(ref_weeks, run_pool(matrix.sparkSession, attribute, ref_weeks, pool)):
        beside = () if "attribution" in rows_of.columns else tuple(cols)
        told = stable(rows_of.select(since(r), *(beside or ("feature", "attribution"))))  # as large as the matrix: one at a time
        summed = attribution_summary(attribution_drift(told, cols=beside)).withColumn("ref_week", F.lit(r).cast("long"))
        part = stable(summed.select("ref_week", "week", "attribution_drift_fraction", "attribution_mean_shift"))
        drop_stable(told)
        shift = part if shift is None else shift.unionByName(part)
    shift = shift.withColumn("week", F.col("week") + F.col("ref_week"))
    pair = ["ref_week", "week"]
    out = summary.join(shift, pair).join(near, pair).withColumn("weeks_since_reference", (F.col("week") - F.col("ref_week")).cast("double"))
    return out.select(*pair, *SIGNALS)
