"""Ranking quality, thresholds and challenger comparison over scored tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import psi_of
from tidemark.operators.distribution import ks_stat, psi
from tidemark.operators.sampling import POISSON_CDF
from tidemark.plans.ordered import CHUNK, chunk_by_value, null_safe_join, running, with_reference
from tidemark.plans.sizing import chunk_count


def scored_rows(df: DataFrame, label: str, *scores: str) -> DataFrame:
    """Rows with a label and all scores; a missing one says nothing about the ranking or the cut."""
    for c in (label, *scores):
        df = df.filter(F.col(c).isNotNull())
    return df


def auc(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score", chunks: int | None = None,
        name: str = "auc") -> DataFrame:
    """Exact area under the ROC curve per group, tied scores sharing a rank; one class gives 0.5.

    Scores are counted per label before they are ordered, so the scan works on distinct scores.
    """
    by, df = list(by), scored_rows(df, label, score)
    counts = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    data = running(chunk_by_value(counts, score, chunks, df), by, [score], {"_upto": ("sum", F.col("_neg"))})
    wins = F.col("_pos") * (F.col("_upto") - F.col("_neg") + F.col("_neg") / 2)
    out = data.df.groupBy(*by).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.sum(wins).alias("_wins"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return out.withColumn(name, F.when(pairs > 0, F.col("_wins") / F.nullif(pairs, F.lit(0.0))).otherwise(0.5)).drop("_wins")


PIECE_SCORES = 1 << 19  # scores that a task counts together before it hands them on


def _piece(held: list[pa.RecordBatch], by: list[str], edges: np.ndarray, which: int) -> Iterator[pa.RecordBatch]:
    """One row per (group, chunk, label) of the ``which``-th scores: the distinct ones as a list, and their counts where a score is repeated; there may
    be a row of either kind."""
    table, keys = pa.Table.from_batches(held), [*by, "_which", CHUNK, "_y"]
    score = pc.list_element(table["_s"], which)
    table = table.set_column(table.schema.get_field_index("_s"), "_s", score).filter(score.is_valid())
    if not len(table):
        return
    place = np.searchsorted(edges, table["_s"].to_numpy(), side="right").astype(np.int32)
    table = table.append_column(CHUNK, pa.array(place)).append_column("_which", pa.repeat(pa.scalar(which, pa.int32()), len(table)))
    seen = table.group_by([*keys, "_s"], use_threads=False).aggregate([([], "count_all")])
    once = pc.equal(seen["count_all"], 1)
    for part, repeated in ((seen.filter(once), False), (seen.filter(pc.invert(once)), True)):
        if part.num_rows:
            lists = part.group_by(keys, use_threads=False).aggregate([("_s", "list"), *([("count_all", "list")] if repeated else [])])
            counts = lists["count_all_list"] if repeated else pa.nulls(len(lists), pa.list_(pa.int64()))
            yield from pa.table([*[lists[k] for k in keys], lists["_s_list"], counts], names=[*keys, "_s", "_n"]).combine_chunks().to_batches()


def _ranked_pairs(table: pa.Table) -> tuple[int, int, float]:
    """Positives, negatives and (positive, lower negative) pairs of a group's pieces, a tie being half a pair."""
    lengths = pc.list_value_length(table["_s"]).to_numpy()
    score, y = pc.list_flatten(table["_s"]).to_numpy(), np.repeat(table["_y"].to_numpy(), lengths)
    hit, miss = score[y == 1], score[y == 0]
    if table["_n"].null_count == len(table):  # no score repeated within a piece
        miss.sort()
        wins = np.searchsorted(miss, hit, "left").sum() + np.searchsorted(miss, hit, "right").sum()
        return len(hit), len(miss), float(wins) / 2
    weight = np.ones(len(score), dtype=np.int64)
    weight[np.repeat(table["_n"].is_valid().to_numpy(), lengths)] = pc.list_flatten(table["_n"]).to_numpy()
    hits, misses, order = weight[y == 1], weight[y == 0], np.argsort(miss)
    upto, miss = np.r_[0, np.cumsum(misses[order])], miss[order]
    wins = (hits.astype(float) * (upto[np.searchsorted(miss, hit, "left")] + upto[np.searchsorted(miss, hit, "right")])).sum()
    return int(hits.sum()), int(misses.sum()), float(wins) / 2


def auc_each(df: DataFrame, by: Sequence[str], label: str = "label", scores: str = "scores", chunks: int | None = None, which: str = "which") -> DataFrame:
    """``auc`` of every place of an array of scores: (by, which, n_pos, n_neg, auc), ``which`` from 0.

    Map tasks count equal scores and pack those of a (group, place, chunk of scores, label) into lists, so a row is never repeated for its scores and
    eight bytes a distinct score are shuffled, once. A (group, place, chunk) is ranked alone; the negatives of lower chunks are added
    afterwards. Edges come from one score a row and only affect balance.
    """
    by, df = list(by), df.filter(F.col(label).isNotNull() & (F.size(scores) > 0))
    y = F.when(F.col(label) == 1, 1).when(F.col(label) == 0, 0).otherwise(-1).cast("byte")
    rows = df.select(*by, y.alias("_y"), F.col(scores).cast("array<double>").alias("_s"))
    count = chunk_count(df) if chunks is None else chunks
    found: list[float] = []
    if count > 1:
        some = F.get("_s", F.pmod(F.xxhash64("_s"), F.size("_s")).cast("int"))
        found = rows.select(some.alias("v")).approxQuantile("v", [i / count for i in range(1, count)], 1.0 / (4 * count))
    edges, types = np.array(sorted(set(found)), dtype=float), dict(rows.dtypes) | {"_which": "int", CHUNK: "int"}
    at, keys = [*by, "_which", CHUNK], [*by, "_which", CHUNK, "_y"]
    schema = lambda cols: ", ".join(f"`{c}` {types[c]}" for c in cols)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b.column("_s").flatten()) for b in held) >= PIECE_SCORES:
                yield from handed(held)
                held = []
        if held:
            yield from handed(held)

    def handed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = max(pc.max(pc.list_value_length(b.column("_s"))).as_py() or 0 for b in held)
        for place in range(longest):
            full = [b.filter(pc.greater(pc.list_value_length(b.column("_s")), place)) for b in held]
            yield from _piece(full, by, edges, place)

    def rank(table: pa.Table) -> pa.Table:
        pos, neg, wins = _ranked_pairs(table)
        return pa.table([*[table[k].slice(0, 1) for k in at], pa.array([pos]), pa.array([neg]), pa.array([wins])], names=[*at, "_pos", "_neg", "_wins"])

    packed = rows.mapInArrow(pieces, schema(keys) + ", _s array<double>, _n array<bigint>")
    ranked = packed.groupBy(*at).applyInArrow(rank, schema(at) + ", _pos bigint, _neg bigint, _wins double")
    lower = Window.partitionBy(*by, "_which").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("_wins") + F.col("_pos").cast("double") * F.coalesce("_before", F.lit(0))
    out = ranked.withColumn("_before", F.sum("_neg").over(lower)).groupBy(*by, F.col("_which").alias(which)).agg(
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.sum(wins).alias("_wins"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return out.withColumn("auc", F.when(pairs > 0, F.col("_wins") / F.nullif(pairs, F.lit(0.0))).otherwise(0.5)).drop("_wins")


SLOTS = 64


def _copies(keys: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """Poisson(1) copies of each row in a replicate, from a mixed 64-bit hash of (row, replicate, seed)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + replicate) & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return np.searchsorted(POISSON_CDF, (x >> np.uint64(11)).astype(float) / 2.0 ** 53, side="right")


def bootstrap_auc(df: DataFrame, by: Sequence[str], key: str, label: str = "label", score: str = "score",
                  n_boot: int = 200, seed: int = 42, chunks: int | None = None) -> DataFrame:
    """AUC of every Poisson-bootstrap replicate: (by, replicate, auc), single-class replicates left out.

    A row's copies depend on its key and the replicate only, so two models scored on the same rows are
    resampled together. Each score chunk yields one row per replicate (its weights and its concordant
    pairs); chunks are then combined by a prefix sum. No row is copied. A score that fills whole chunks by itself is
    spread over ``SLOTS`` groups, as the weights of tied rows only need to be added.
    """
    by, df = list(by), scored_rows(df, label, score)
    rows = df.select(*by, F.xxhash64(F.col(key)).alias("_key"), F.col(label).cast("int").alias("_y"), F.col(score).cast("double").alias("_s"))
    data = chunk_by_value(rows, "_s", chunks)
    tied = F.col("_s").isin(*data.heavy) if data.heavy else F.lit(False)
    slot = F.when(F.col("_tail") == 0, F.pmod("_key", F.lit(SLOTS)).cast("int")).otherwise(0)
    data = data.with_df(data.df.withColumn("_tail", F.when(tied, 0).otherwise(1)).withColumn("_slot", slot))
    keep = [*by, CHUNK, "_tail", "_slot"]
    types = dict(data.df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", replicate int, pos double, neg double, wins double"

    def chunk_stats(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s", kind="stable")
        keys, y, s = pdf["_key"].to_numpy(), pdf["_y"].to_numpy() == 1, pdf["_s"].to_numpy()
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        out = np.empty((n_boot, 3))
        for b in range(n_boot):
            w = _copies(keys, b, seed)
            pos = np.add.reduceat(np.where(y, w, 0), starts).astype(float)
            neg = np.add.reduceat(np.where(y, 0, w), starts).astype(float)
            out[b] = pos.sum(), neg.sum(), (pos * (np.cumsum(neg) - neg / 2)).sum()
        head = {c: [pdf[c].iloc[0]] * n_boot for c in keep}
        return pd.DataFrame({**head, "replicate": np.arange(n_boot, dtype=np.int32), "pos": out[:, 0], "neg": out[:, 1], "wins": out[:, 2]})

    parts = data.df.groupBy(*keep).applyInPandas(chunk_stats, schema)
    # A heavy score is the lower edge of its chunk, hence before the chunk's other rows.
    joined = parts.groupBy(*by, CHUNK, "_tail", "replicate").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("wins").alias("wins"))
    joined = joined.withColumn("wins", F.when(F.col("_tail") == 0, F.col("pos") * F.col("neg") / 2).otherwise(F.col("wins")))
    before = Window.partitionBy(*by, "replicate").orderBy(CHUNK, "_tail").rowsBetween(Window.unboundedPreceding, -1)
    total = joined.withColumn("_before", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    out = total.groupBy(*by, "replicate").agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum(F.col("wins") + F.col("pos") * F.col("_before")).alias("_w"))
    return out.filter((F.col("_p") > 0) & (F.col("_n") > 0)).select(*by, "replicate", (F.col("_w") / (F.col("_p") * F.col("_n"))).alias("auc"))


def bootstrap_auc_se(df: DataFrame, by: Sequence[str], key: str, label: str = "label", score: str = "score",
                     n_boot: int = 200, seed: int = 42, chunks: int | None = None) -> DataFrame:
    """Standard error of the AUC per group; fewer than 50 rows gives 0."""
    reps = bootstrap_auc(df, by, key, label, score, n_boot, seed, chunks)
    se = reps.groupBy(*by).agg(F.stddev_pop("auc").alias("_se"))
    sizes = scored_rows(df, label, score).groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    out = null_safe_join(sizes, se, list(by), "left")
    return out.select(*by, F.when(F.col("_rows") >= 50, F.coalesce("_se", F.lit(0.0))).otherwise(0.0).alias("auc_se"))


def paired_gap_se(df: DataFrame, by: Sequence[str], key: str, label: str, score_a: str, score_b: str,
                  n_boot: int = 200, seed: int = 42, chunks: int | None = None) -> DataFrame:
    """Standard error of AUC(b) - AUC(a) with rows resampled together."""
    df = scored_rows(df, label, score_a, score_b)
    long = df.select(*by, key, label, F.explode(F.array(
        F.struct(F.lit("a").alias("m"), F.col(score_a).alias("s")), F.struct(F.lit("b").alias("m"), F.col(score_b).alias("s")))).alias("_x"))
    long = long.select(*by, key, label, F.col("_x.m").alias("_model"), F.col("_x.s").alias("_score"))
    reps = bootstrap_auc(long, [*by, "_model"], key, label, "_score", n_boot, seed, chunks)
    gaps = reps.groupBy(*by, "replicate").agg(
        (F.max(F.when(F.col("_model") == "b", F.col("auc"))) - F.max(F.when(F.col("_model") == "a", F.col("auc")))).alias("gap"))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    out = null_safe_join(sizes, gaps.groupBy(*by).agg(F.stddev_pop("gap").alias("_se")), list(by), "left")
    return out.select(*by, F.when(F.col("_rows") >= 50, F.coalesce("_se", F.lit(0.0))).otherwise(0.0).alias("auc_gap_se"))


def prequential_auc(df: DataFrame, key: str, week: str = "week", label: str = "label", score: str = "score",
                    by: Sequence[str] = (), min_drop: float = 0.02, n_sigma: float = 2.0, n_boot: int = 200,
                    seed: int = 42, chunks: int | None = None) -> DataFrame:
    """AUC of each window against week 0: drift when the drop clears the floor and n_sigma errors."""
    by = list(by)
    each = auc(df, [*by, week], label, score, chunks)
    cur = with_reference(each, by, week, {"auc": "reference_auc"}).select(
        *by, week, "reference_auc", F.col("auc").alias("current_auc"), F.col("n_pos").alias("n_positives"))
    se = bootstrap_auc_se(df.filter(F.col(week) > 0), [*by, week], key, label, score, n_boot, seed, chunks)
    both = null_safe_join(cur, se, [*by, week])
    drop = F.col("reference_auc") - F.col("current_auc")
    clear = F.when(F.col("auc_se") > 0, F.col("auc_drop") > n_sigma * F.col("auc_se")).otherwise(F.col("auc_drop") > min_drop)
    return (both.withColumn("auc_drop", drop).withColumn("drift_detected", (F.col("auc_drop") > min_drop) & clear)
            .withColumn("warning_detected", ~F.col("drift_detected") & (F.col("auc_drop") > min_drop * 0.5)))


def threshold_counts(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score",
                     low: float = 0.05, high: float = 0.95, points: int = 91) -> DataFrame:
    """Confusion counts at every point of the threshold grid, from one histogram of the scores.

    Each row is counted once, in the highest grid point it reaches; the counts above a point are a suffix sum
    over at most ``points`` rows per group.
    """
    by, df = list(by), scored_rows(df, label, score)
    grid = [low + i * (high - low) / (points - 1) for i in range(points)]
    edges = F.array(*[F.lit(g) for g in grid])
    step = (high - low) / (points - 1)
    guess = F.greatest(F.lit(0), F.least(F.lit(points), F.floor((F.col(score) - low) / step).cast("int") + 1))
    settled = guess - F.when((guess > 0) & (F.col(score) < F.get(edges, guess - 1)), 1).otherwise(0) \
        + F.when((guess < points) & (F.col(score) >= F.get(edges, guess)), 1).otherwise(0)
    hist = df.withColumn("_slot", settled).groupBy(*by, "_slot").agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    slots = hist.groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"),
                                  F.map_from_entries(F.collect_list(F.struct("_slot", F.struct("_p", "_n")))).alias("_m"))
    rows = slots.select(*by, "n_pos", "n_neg", "_m", F.posexplode(edges).alias("_i", "threshold"))
    at = rows.withColumn("_p", F.coalesce(F.try_element_at("_m", F.col("_i") + 1)["_p"], F.lit(0))) \
             .withColumn("_n", F.coalesce(F.try_element_at("_m", F.col("_i") + 1)["_n"], F.lit(0)))
    suffix = Window.partitionBy(*by).orderBy("_i").rowsBetween(0, Window.unboundedFollowing)
    return at.select(*by, "threshold", "_i", "n_pos", "n_neg", F.sum("_p").over(suffix).alias("tp"), F.sum("_n").over(suffix).alias("fp"))


def tune_threshold(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """The first grid threshold with the highest F1 per group; one class gives 0.5."""
    grid = threshold_counts(df, by, label, score)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos")), F.lit(0.0))
    best = grid.withColumn("f1", f1).groupBy(*by).agg(
        F.max(F.struct("f1", (-F.col("_i")).alias("first"), "threshold")).alias("_b"), F.max("n_pos").alias("_p"), F.max("n_neg").alias("_n"))
    one = (F.col("_p") == 0) | (F.col("_n") == 0)
    return best.select(*by, F.when(one, 0.5).otherwise(F.col("_b.threshold")).alias("threshold"),
                       F.when(one, F.lit(None)).otherwise(F.col("_b.f1")).alias("f1"))


def confusion_counts(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score",
                     threshold: float | Column = 0.5) -> DataFrame:
    """Counts per (group, label, prediction)."""
    cut, df = F.lit(threshold) if isinstance(threshold, float) else threshold, scored_rows(df, label, score)
    return (df.groupBy(*by, F.col(label).cast("int").alias("label"), (F.col(score) >= cut).cast("int").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def f1_at(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score",
          threshold: float | Column = 0.5) -> DataFrame:
    """Precision, recall and F1 at a cut; an undefined ratio is 0."""
    cut, df = F.lit(threshold) if isinstance(threshold, float) else threshold, scored_rows(df, label, score)
    hit = F.col(score) >= cut
    out = df.groupBy(*by).agg(F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"),
                              F.count_if(~hit & (F.col(label) == 1)).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
            .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)))


def f1_each(df: DataFrame, by: Sequence[str], label: str, scores: str, n: int, threshold: float | Column = 0.5, which: str = "which") -> DataFrame:
    """F1 at a cut of each of the ``n`` places of an array of scores: (by, which, f1), counted in one pass that repeats no row."""
    cut, df = F.lit(threshold) if isinstance(threshold, float) else threshold, df.filter(F.col(label).isNotNull())
    counts = []
    for i in range(n):
        hit = F.get(scores, F.lit(i)) >= cut
        counts += [F.count_if(hit & (F.col(label) == 1)).alias(f"_tp{i}"), F.count_if(hit & (F.col(label) == 0)).alias(f"_fp{i}"),
                   F.count_if(~hit & (F.col(label) == 1)).alias(f"_fn{i}")]
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(f"_tp{i}"), 2 * F.col(f"_tp{i}") + F.col(f"_fp{i}") + F.col(f"_fn{i}")), F.lit(0.0)) for i in range(n)]
    return df.groupBy(*by).agg(*counts).select(*by, F.posexplode(F.array(*f1)).alias(which, "f1"))


def evaluate(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score",
             threshold: float | Column = 0.5, chunks: int | None = None) -> DataFrame:
    """AUC and F1 per group."""
    cut = f1_at(df, by, label, score, threshold).select(*by, "f1")
    return null_safe_join(auc(df, by, label, score, chunks).select(*by, "auc"), cut, list(by))


def champion_challenger(df: DataFrame, key: str, by: Sequence[str] = ("week",), label: str = "label",
                        champion: str = "champion", challenger: str = "challenger",
                        baseline_auc: float | None = None, max_degradation: float = 0.05, min_gap: float = 0.03,
                        out_of_fold: bool = True, n_boot: int = 200, seed: int = 42, chunks: int | None = None) -> DataFrame:
    """Incumbent against challenger on the same rows, per window.

    Drift: the champion fell more than ``max_degradation`` below its baseline, or the challenger's lead
    exceeds both ``min_gap`` and its own bootstrap error.
    """
    by, df = list(by), scored_rows(df, label, champion, challenger)
    sides = df.select(*by, key, label, F.explode(F.array(
        F.struct(F.lit("champion").alias("m"), F.col(champion).alias("s")),
        F.struct(F.lit("challenger").alias("m"), F.col(challenger).alias("s")))).alias("_x"))
    sides = sides.select(*by, key, F.col(label).alias("label"), F.col("_x.m").alias("side"), F.col("_x.s").alias("score"))
    scored = evaluate(sides, [*by, "side"], chunks=chunks)
    pick = lambda c, m: F.max(F.when(F.col("side") == m, F.col(c)))
    wide = scored.groupBy(*by).agg(*[pick(c, m).alias(f"{m}_{c}") for m in ("champion", "challenger") for c in ("auc", "f1")])
    # Champion scores act as the reference side of the two distribution statistics.
    shape = sides.select(*by, F.when(F.col("side") == "champion", 0).otherwise(1).alias("_side"), F.col("score").alias("_v"))
    ks = ks_stat(shape, by, "_side", "_v", chunks=chunks).select(*by, F.col("statistic").alias("prediction_ks_stat"))
    moved = psi(shape, by, "_side", "_v", chunks=chunks).select(*by, F.col("psi").alias("prediction_psi"))
    se = paired_gap_se(df, by, key, label, champion, challenger, n_boot, seed, chunks)
    out = null_safe_join(null_safe_join(null_safe_join(wide, ks, by, "left"), moved, by, "left"), se, by, "left")
    fall = F.lit(baseline_auc) - F.col("champion_auc") if baseline_auc is not None else F.lit(0.0)
    gap = F.col("challenger_auc") - F.col("champion_auc")
    return (out.withColumn("auc_gap", gap).withColumn("auc_degradation", fall)
            .withColumn("auc_gap_significant", F.col("auc_gap") > F.greatest(F.lit(min_gap), F.col("auc_gap_se")))
            .withColumn("drift_detected", (F.col("auc_degradation") > max_degradation) | F.col("auc_gap_significant"))
            .withColumn("warning_detected", ~F.col("drift_detected") & (
                (F.col("auc_degradation") > max_degradation * 0.5) | (F.col("auc_gap") > min_gap * 0.5)))
            .withColumn("out_of_fold", F.lit(out_of_fold)))


__all__ = ["auc", "auc_each", "bootstrap_auc", "bootstrap_auc_se", "champion_challenger", "confusion_counts", "evaluate", "f1_at", "f1_each",
           "paired_gap_se", "prequential_auc", "psi_of", "threshold_counts", "tune_threshold"]
