"""Streaming forms: frozen-edge histograms, keyed detectors, confirmation, encoder replay, listing upsert.

The watermark delay is this library's choice (one day by default); rows later than that are dropped.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.numeric import psi_of
from tidemark.operators.encoders import frequency_encode, ordinal_encode
from tidemark.operators.listings import upsert_matches
from tidemark.sources.tables import BucketedTable, last_batch, mark_batch


def weekly_bin_counts(stream: DataFrame, edges: DataFrame, ts: str = "ts", window: str = "7 days", delay: str = "1 day",
                      buckets: int = 10, cutoff: int = 0) -> DataFrame:
    """Tumbling counts per (window, feature) over frozen reference edges.

    ``stream`` is (ts, feature, value); ``edges`` is one short array per feature. Windows start at ``cutoff`` (seconds since
    1970), the end of the reference, so that they are the weeks of ``assign_week``. The state is ``buckets`` counters per
    open window and feature, whatever the traffic.
    """
    rows = stream.withWatermark(ts, delay).join(F.broadcast(edges), "feature")
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    rows = rows.filter(F.col("value").isNotNull()).withColumn("_bin", F.size(F.filter(inner, lambda e: e <= F.col("value"))))
    out = rows.groupBy(F.window(ts, window, window, f"{cutoff} seconds"), "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"),
        *[F.count_if(F.col("_bin") == i).alias(f"_b{i}") for i in range(buckets)])
    counts = F.array(*[f"_b{i}" for i in range(buckets)])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "feature", "n", "mean", "low", "high", counts.alias("counts"))


def late_rows(query: StreamingQuery) -> int:
    """How many rows the query has left out so far as older than its watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])


def psi_from_counts(windows: DataFrame, reference: DataFrame) -> DataFrame:
    """PSI of closed windows against (feature, ref_counts, n_ref)."""
    both = windows.join(F.broadcast(reference), "feature")
    used = F.size("ref_counts")
    usable = (F.col("n") >= 10) & (F.col("n_ref") >= 10) & (used >= 2)
    return both.withColumn("psi", F.when(usable, psi_of(F.col("ref_counts"), F.slice("counts", F.lit(1), used), F.col("n_ref"), F.col("n"))).otherwise(0.0)).drop("ref_counts", "n_ref")


STATE = "n bigint, total double, p_min double, s_min double, ps_min double, k bigint, s1 double, s2 double, top double, last_error bigint, n_best bigint, total_best double"
START = (0, 0.0, 0.0, 0.0, math.inf, 0, 0.0, 0.0, 0.0, 0, 0, 0.0)
LAST = "last_seq bigint"  # of the rows taken so far
DETECTIONS = "method string, version bigint, seq bigint, detector string, drift boolean, warning boolean, value double, threshold double"


def _since(better: np.ndarray) -> np.ndarray:
    """Index of the latest true position so far, -1 before the first."""
    return np.maximum.accumulate(np.where(better, np.arange(len(better)), -1))


def advance(state: tuple, x: np.ndarray, cfg: dict) -> tuple[tuple, list[tuple]]:
    """Continue the three trackers over one ordered batch of errors.

    Returns the new state and, per detector, (name, positions, drift, warning, value, threshold) arrays.
    """
    n0, total0, p_min, s_min, ps_min, k0, s1, s2, top, last_error, n_best, total_best = state
    n = n0 + np.arange(1, len(x) + 1)
    total = total0 + np.cumsum(x)
    p = total / n
    dev = np.sqrt(np.maximum(0.0, p * (1 - p)) / n)
    found = []
    # Error rate against its best level.
    ready = n >= cfg["min_instances"]
    level = np.where(ready, p + dev, np.inf)
    lowest = np.minimum.accumulate(np.r_[ps_min, level])
    at = _since(level < lowest[:-1])
    pm, sm = np.where(at >= 0, p[at], p_min), np.where(at >= 0, dev[at], s_min)
    hi, lo = pm + cfg["drift_level"] * sm, pm + cfg["warning_level"] * sm
    drift = ready & (level > hi)
    found.append(("ddm", np.arange(len(x)), drift, ready & ~drift & (level > lo), p + dev, hi))
    # Distance between errors against its largest value.
    hits = np.flatnonzero(x.astype(int) == 1)
    places = np.r_[last_error, n[hits]] if last_error else n[hits]
    gaps, where = np.diff(places).astype(float), hits if last_error else hits[1:]
    k = k0 + np.arange(1, len(gaps) + 1)
    sum1, sum2 = s1 + np.cumsum(gaps), s2 + np.cumsum(gaps * gaps)
    metric = sum1 / k + 2 * np.sqrt(np.maximum(0.0, sum2 / k - (sum1 / k) ** 2))
    best = np.maximum.accumulate(np.r_[top, metric])[1:]
    usable = (k >= cfg["min_errors"]) & (best > 0)
    drift = usable & (metric < cfg["beta_drift"] * best)
    found.append(("eddm", where, drift, usable & ~drift & (metric < cfg["beta_warning"] * best), metric, cfg["beta_drift"] * best))
    # Mean against the best prefix, by Hoeffding bounds.
    bound = lambda m, c: np.sqrt(math.log(2.0 / c) / (2.0 * np.maximum(m, 1)))
    dc, wc = cfg["drift_confidence"], cfg["warning_confidence"]
    reach = p + bound(n, dc)
    first = total_best / n_best + bound(n_best, dc) if n_best else np.inf
    at = _since(reach <= np.minimum.accumulate(np.r_[first, reach])[:-1])
    nb, tb = np.where(at >= 0, n[at], n_best), np.where(at >= 0, total[at], total_best)
    rise, hi = p - tb / np.maximum(nb, 1), bound(nb, dc) + bound(n, dc)
    drift = rise > hi
    found.append(("hddm", np.arange(len(x)), drift, ~drift & (rise > bound(nb, wc) + bound(n, wc)), rise, hi))
    tail = (int(k[-1]), float(sum1[-1]), float(sum2[-1]), float(best[-1])) if len(gaps) else (k0, s1, s2, top)
    new = (int(n[-1]), float(total[-1]), float(pm[-1]), float(sm[-1]), float(lowest[-1]), *tail,
           int(places[-1]) if len(places) else last_error, int(nb[-1]), float(tb[-1]))
    return new, found


DEFAULTS = {"min_instances": 30, "warning_level": 2.0, "drift_level": 3.0, "beta_drift": 0.90, "beta_warning": 0.95, "min_errors": 10,
            "drift_confidence": 0.001, "warning_confidence": 0.005}


PIECE = 65_536  # rows that the trackers take at a time


def in_order(frames: Iterator[pd.DataFrame], piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(seq, err) of all rows by ``seq``, rows of one ``seq`` as they came, about ``piece`` rows at a time.

    Held are two numbers a row, in sorted runs; a piece is gathered from the runs when it is due.
    """
    runs, some, n = [], [], 0

    def close() -> None:
        nonlocal n
        seq, err = (np.concatenate(x) for x in zip(*some))
        order = np.argsort(seq, kind="stable")
        runs.append((seq[order], err[order]))
        some.clear()
        n = 0
    for frame in frames:
        if not len(frame):
            continue
        if frame["seq"].isna().any():
            raise ValueError("a row has no seq")
        some.append((frame["seq"].to_numpy(dtype=np.int64), frame["err"].to_numpy(dtype=float)))
        n += len(frame)
        if n >= 16 * piece:
            close()
    if some:
        close()
    at = [0] * len(runs)
    while any(a < len(seq) for a, (seq, _) in zip(at, runs)):
        share = max(1, piece // len(runs))
        # No run has more than its share up to the least of these, and one has all of it.
        cut = min(seq[min(a + share, len(seq)) - 1] for a, (seq, _) in zip(at, runs) if a < len(seq))
        ends = [int(np.searchsorted(seq, cut, "right")) for seq, _ in runs]
        seq, err = (np.concatenate([run[i][a:b] for run, a, b in zip(runs, at, ends)]) for i in (0, 1))
        order, at = np.argsort(seq, kind="stable"), ends
        yield seq[order], err[order]


def stream_detectors(stream: DataFrame, **over: float) -> DataFrame:
    """DDM, EDDM and HDDM as keyed state over (method, version, seq, err).

    A new model version is a new key, so its trackers start afresh. Rows of a micro-batch are taken in ``seq`` order and
    advanced as arrays, a piece at a time; only rows that raise a warning or an alarm are emitted. The state is thirteen numbers per key.
    The trackers can't go back, so rows that come in a later batch than rows with a greater ``seq`` are left out; a row of the detector
    ``late`` tells how many (``value``) and behind which ``seq`` (``threshold``).
    Of a key's share of one micro-batch two numbers a row are held in memory (``in_order``), whatever the trackers make of them; bound it further with
    the source's ``maxFilesPerTrigger`` or the like, or use the batch operators for a backlog, which split a stream over many tasks.
    """
    cfg = {**DEFAULTS, **over}

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = (tuple(state.get)[:-1], int(state.get[-1])) if state.exists else (START, None)
        before, first_late, late = last, None, 0
        for seq, err in in_order(frames):
            if before is not None and (n := int(np.searchsorted(seq, before, "right"))):
                first_late, late = int(seq[0]) if first_late is None else first_late, late + n
                seq, err = seq[n:], err[n:]
            for i in range(0, len(seq), PIECE):
                some = seq[i:i + PIECE]
                held, found = advance(held, np.clip(err[i:i + PIECE], 0.0, 1.0), cfg)
                last = int(some[-1])
                for name, where, drift, warn, value, cut in found:
                    show = drift | warn
                    if show.any():
                        yield pd.DataFrame({"method": key[0], "version": key[1], "seq": some[where[show]], "detector": name, "drift": drift[show],
                                            "warning": warn[show], "value": value[show], "threshold": cut[show]})
        if late:
            yield pd.DataFrame({"method": [key[0]], "version": [key[1]], "seq": [first_late], "detector": ["late"], "drift": [False], "warning": [True],
                                "value": [float(late)], "threshold": [float(before)]})
        if last is not None and last != before:
            state.update((*held, last))

    return stream.groupBy("method", "version").applyInPandasWithState(update, DETECTIONS, f"{STATE}, {LAST}", "append", GroupStateTimeout.NoTimeout)


def stream_confirm(flags: DataFrame, k: int = 2, n: int = 2, reset: bool = True) -> DataFrame:
    """k-of-n confirmation of (method, week, raw_flag) with the last n flags as state; a confirmation clears them."""
    if k > n:
        raise ValueError("k must not exceed n")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = [c == "1" for c in state.get[0]] if state.exists else []
        data = pd.concat(list(frames), ignore_index=True).sort_values("week", kind="stable")
        out = []
        for week, flag in zip(data["week"], data["raw_flag"]):
            recent = [*recent, bool(flag)][-n:]
            hit = sum(recent) >= k
            out.append((key[0], week, bool(flag), hit))
            if hit and reset:
                recent = []
        state.update(("".join("1" if f else "0" for f in recent),))
        yield pd.DataFrame(out, columns=["method", "week", "raw_flag", "confirmed_flag"])

    return flags.groupBy("method").applyInPandasWithState(update, "method string, week bigint, raw_flag boolean, confirmed_flag boolean", "recent string", "append", GroupStateTimeout.NoTimeout)


def stream_encode(stream: DataFrame, freq: DataFrame, freq_cols: Sequence[str], codes: DataFrame, code_cols: Sequence[str]) -> DataFrame:
    """Frozen encoders replayed on a stream: stream-static joins with the state tables."""
    return ordinal_encode(frequency_encode(stream, freq, freq_cols), codes, code_cols)


def stream_upsert(stream: DataFrame, table: BucketedTable, schema: str, now: Callable[[], Column], order: str, checkpoint: str,
                  event_time: str | None = None, delay: str = "1 day"):
    """Upsert each micro-batch of matches into the keyed table; repeated rows within the delay are dropped.

    Only the buckets that a batch touches are read and replaced. A batch that Spark hands over again after it was merged is left out: its
    number is noted beside the checkpoint once the merge is through.
    """
    rows = stream if event_time is None else stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["id", order])
    notes = f"{checkpoint}-merged"

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number > last_batch(spark, notes):
            if not batch.isEmpty():
                table.merge(batch, lambda old, new: upsert_matches(old, new, now(), order), schema, ["match_score"])
            mark_batch(spark, notes, number)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
