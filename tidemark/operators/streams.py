"""Error-stream detectors as running aggregates over an ordered stream, plus flag confirmation.

A stream is (stream columns, week, seq, err): the stream columns name a method and model version, so a new
version starts afresh. Streams are scanned in ordered chunks, so one very long stream uses many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import hoeffding_bound, normal_cut
from tidemark.operators.sampling import hash_rank
from tidemark.plans.checkpoints import stable
from tidemark.plans.ordered import Chunked, chunk_by_value, null_safe_join, plain, previous, row_index, running, with_reference


def error_stream(df: DataFrame, label: str, score: str, mode: str = "balanced", threshold: float = 0.5,
                 key: str = "seq", by: Sequence[str] = (), seed: int = 42, chunks: int | None = None) -> DataFrame:
    """Adds ``err``: 1[wrong] (zero_one), squared error (brier), or 1[wrong] on a class-balanced subset.

    Balanced keeps every positive and as many negatives of the same group by hash rank; a group with a single
    class keeps all its rows. Row order is carried by ``key``.
    """
    wrong = ((F.col(score) >= threshold).cast("int") != F.col(label).cast("int")).cast("double")
    if mode == "brier":
        gap = F.col(label).cast("double") - F.col(score)
        return df.withColumn("err", F.greatest(F.lit(0.0), F.least(F.lit(1.0), gap * gap)))
    if mode == "zero_one":
        return df.withColumn("err", wrong)
    if mode != "balanced":
        raise ValueError(f"unknown error stream mode {mode!r}")
    ranked = hash_rank(df, key, seed, [*by, label], "_rank", chunks)
    sizes = df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    both = null_safe_join(ranked, sizes, list(by))
    keep = (F.col(label) == 1) | (F.col("_rank") <= F.col("_pos")) | (F.col("_pos") == 0) | (F.col("_neg") == 0)
    return both.filter(keep).withColumn("err", wrong).drop("_rank", "_pos", "_neg")


def _steady(data: Chunked) -> Chunked:
    """Between two passes of a chunked scan, write the first result once instead of computing it twice."""
    return data.with_df(stable(data.df))


def ddm_rows(df: DataFrame, by: Sequence[str], order: str = "seq", err: str = "err", min_instances: int = 30,
             warning_level: float = 2.0, drift_level: float = 3.0, chunks: int | None = None) -> DataFrame:
    """Per row: running error rate p, its deviation s, their minimum so far, warning and drift flags."""
    data = chunk_by_value(df, order, chunks)
    data = running(data, by, [order], {"n": ("count", F.lit(1)), "_sum": ("sum", F.col(err))})
    p = F.col("_sum") / F.col("n")
    data = data.with_df(data.df.withColumn("p", p).withColumn("s", F.sqrt(F.greatest(F.lit(0.0), F.col("p") * (1 - F.col("p"))) / F.col("n"))))
    best = F.when(F.col("n") >= min_instances, F.struct((F.col("p") + F.col("s")).alias("ps"), "n", "p", "s"))
    data = running(_steady(data), by, [order], {"_best": ("min", best)})
    ready = F.col("n") >= min_instances
    ps = F.col("p") + F.col("s")
    drift = ready & (ps > F.col("_best.p") + drift_level * F.col("_best.s"))
    warn = ready & ~drift & (ps > F.col("_best.p") + warning_level * F.col("_best.s"))
    return plain(data.df.withColumn("p_min", F.col("_best.p")).withColumn("s_min", F.col("_best.s"))
            .withColumn("drift", F.coalesce(drift, F.lit(False))).withColumn("warning", F.coalesce(warn, F.lit(False)))
            .drop("_sum", "_best"))


def ddm(df: DataFrame, by: Sequence[str], week: str = "week", order: str = "seq", err: str = "err",
        warning_level: float = 2.0, drift_level: float = 3.0, **kw) -> DataFrame:
    """One row per (stream, week): alarms of that batch and the state at its end."""
    rows = ddm_rows(df, by, order, err, warning_level=warning_level, drift_level=drift_level, **kw)
    out = rows.groupBy(*by, week).agg(
        F.count_if("drift").alias("drift_occurrences"), F.count_if("warning").alias("_warnings"),
        F.avg(err).alias("mean_error_rate"), F.max_by(F.struct("p_min", "s_min"), "n").alias("_end"))
    return (out.withColumn("p_min", F.coalesce(F.col("_end.p_min"), F.col("mean_error_rate")))
            .withColumn("s_min", F.coalesce(F.col("_end.s_min"), F.lit(0.0)))
            .withColumn("drift_detected", F.col("drift_occurrences") > 0)
            .withColumn("warning_detected", F.col("_warnings") > 0)
            .withColumn("drift_threshold", F.col("p_min") + drift_level * F.col("s_min"))
            .withColumn("warning_threshold", F.col("p_min") + warning_level * F.col("s_min"))
            .drop("_end", "_warnings"))


def eddm_rows(df: DataFrame, by: Sequence[str], order: str = "seq", err: str = "err", beta_drift: float = 0.90,
              beta_warning: float = 0.95, min_errors: int = 10, chunks: int | None = None) -> DataFrame:
    """Per error row after the first: gap since the previous error, metric mean + 2 std, its maximum, flags."""
    data = chunk_by_value(df, order, chunks)
    data = row_index(data, by, [order], "n")
    errors = _steady(data.with_df(data.df.filter(F.col(err).cast("int") == 1)))
    errors = previous(errors, by, [order], {"_prev": "n"})
    gap = (F.col("n") - F.col("_prev")).cast("double")
    errors = errors.with_df(errors.df.filter(F.col("_prev").isNotNull()).withColumn("gap", gap))
    errors = running(_steady(errors), by, [order], {
        "k": ("count", F.lit(1)), "_s1": ("sum", F.col("gap")), "_s2": ("sum", F.col("gap") * F.col("gap"))})
    mean = F.col("_s1") / F.col("k")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_s2") / F.col("k") - mean * mean))
    errors = errors.with_df(errors.df.withColumn("metric", mean + 2 * std))
    errors = running(_steady(errors), by, [order], {"max_metric": ("max", F.col("metric"))})
    ready = (F.col("k") >= min_errors) & (F.col("max_metric") > 0)
    drift = ready & (F.col("metric") < beta_drift * F.col("max_metric"))
    return plain(errors.df.withColumn("drift", drift)
            .withColumn("warning", ready & ~drift & (F.col("metric") < beta_warning * F.col("max_metric")))
            .drop("_s1", "_s2", "_prev"))


def eddm(df: DataFrame, by: Sequence[str], week: str = "week", order: str = "seq", err: str = "err",
         beta_drift: float = 0.90, beta_warning: float = 0.95, **kw) -> DataFrame:
    """One row per (stream, week). The metric at the end of a batch without errors is the previous one."""
    rows = eddm_rows(df, by, order, err, beta_drift, beta_warning, **kw)
    alarms = rows.groupBy(*by, week).agg(
        F.max("drift").alias("_d"), F.max("warning").alias("_w"),
        F.max_by(F.struct("metric", "max_metric"), "n").alias("_end"))
    base = df.groupBy(*by, week).agg(F.avg(F.col(err).cast("int")).alias("mean_error_rate"))
    both = null_safe_join(base, alarms, [*by, week], "left")
    # One row per (stream, week) from here on.
    w = Window.partitionBy(*by).orderBy(week).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_end", ignorenulls=True).over(w))
    drift = F.coalesce("_d", F.lit(False))
    metric, top = F.coalesce("_last.metric", F.lit(0.0)), F.coalesce("_last.max_metric", F.lit(0.0))
    return both.select(*by, week, drift.alias("drift_detected"),
                       (F.coalesce("_w", F.lit(False)) & ~drift).alias("warning_detected"),
                       drift.cast("long").alias("drift_occurrences"), "mean_error_rate",
                       metric.alias("metric_value"), top.alias("max_metric"),
                       (beta_drift * top).alias("drift_threshold"), (beta_warning * top).alias("warning_threshold"))


def hddm_rows(df: DataFrame, by: Sequence[str], order: str = "seq", err: str = "err", drift_confidence: float = 0.001,
              warning_confidence: float = 0.005, chunks: int | None = None) -> DataFrame:
    """Per row: running mean, the best prefix so far by mean plus bound, and flags."""
    clipped = df.withColumn("_x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(err).cast("double"))))
    data = chunk_by_value(clipped, order, chunks)
    data = running(data, by, [order], {"n": ("count", F.lit(1)), "_sum": ("sum", F.col("_x"))})
    data = data.with_df(data.df.withColumn("mean", F.col("_sum") / F.col("n")))
    best = F.struct((F.col("mean") + hoeffding_bound(F.col("n"), drift_confidence)).alias("b"), (-F.col("n")).alias("neg_n"), "mean")
    data = running(_steady(data), by, [order], {"_best": ("min", best)})
    n_min = -F.col("_best.neg_n")
    rise = F.col("mean") - F.col("_best.mean")

    def over(conf: float) -> Column:
        return rise > hoeffding_bound(n_min, conf) + hoeffding_bound(F.col("n"), conf)

    return plain(data.df.withColumn("mean_min", F.col("_best.mean")).withColumn("drift", over(drift_confidence))
            .withColumn("warning", ~F.col("drift") & over(warning_confidence)).drop("_sum", "_x", "_best"))


def hddm(df: DataFrame, by: Sequence[str], week: str = "week", order: str = "seq", err: str = "err",
         drift_confidence: float = 0.001, warning_confidence: float = 0.005, **kw) -> DataFrame:
    """One row per (stream, week)."""
    rows = hddm_rows(df, by, order, err, drift_confidence, warning_confidence, **kw)
    clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(err).cast("double")))
    out = rows.groupBy(*by, week).agg(
        F.count_if("drift").alias("drift_occurrences"), F.count_if("warning").alias("_w"), F.avg(clip).alias("mean_error_rate"),
        F.max_by("mean_min", "n").alias("reference_mean"), F.max("n").alias("_n"))
    return (out.withColumn("drift_detected", F.col("drift_occurrences") > 0)
            .withColumn("warning_detected", (F.col("_w") > 0) & ~F.col("drift_detected"))
            .withColumn("hoeffding_bound", hoeffding_bound(F.col("_n"), drift_confidence)).drop("_w", "_n"))


def _z_columns(df: DataFrame, delta: float) -> DataFrame:
    """Welch z from n1, mean1, var1, n2, mean2, var2."""
    cut = normal_cut(delta)
    spread = F.coalesce("var1", F.lit(0.0)) + F.coalesce("var2", F.lit(0.0))
    se = F.when(spread > 0, F.sqrt(F.col("var1") / F.col("n1") + F.col("var2") / F.col("n2"))).otherwise(F.lit(1e-10))
    small = (F.col("n1") < 2) | (F.col("n2") < 2)
    z = F.when(small, 0.0).otherwise(F.abs(F.col("mean1") - F.col("mean2")) / se)
    return (df.withColumn("estimation", F.coalesce("mean2", F.lit(0.0))).withColumn("z_score", z)
            .withColumn("z_threshold", F.lit(cut)).withColumn("drift_detected", F.col("z_score") > cut)
            .withColumn("warning_detected", (F.col("z_score") > cut * 0.8) & ~F.col("drift_detected")))


def two_sample_z(df: DataFrame, by: Sequence[str], week: str = "week", value: str = "value", delta: float = 0.002) -> DataFrame:
    """Welch z of every window against week 0; fewer than two rows on a side stays quiet."""
    stats = df.groupBy(*by, week).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    both = with_reference(stats, by, week, {"n": "n1", "mean": "mean1", "var": "var1"}).fillna(0, ["n1"])
    both = both.withColumnsRenamed({"n": "n2", "mean": "mean2", "var": "var2"})
    return _z_columns(both, delta).select(*by, week, "estimation", "z_score", "z_threshold", "drift_detected", "warning_detected")


def adwin(df: DataFrame, by: Sequence[str], week: str = "week", order: str = "seq", value: str = "value",
          delta: float = 0.002, has_reference: bool = True, chunks: int | None = None) -> DataFrame:
    """Mean shift of a stream: against week 0, or early against late half of each window without a reference.

    The decision is the two-sample z rule. The early half is the first n div 2 rows in order.
    """
    if has_reference:
        return two_sample_z(df, by, week, value, delta).withColumn("drift_occurrences", F.col("drift_detected").cast("long"))
    data = row_index(chunk_by_value(df, order, chunks), [*by, week], [order], "_pos")
    sizes = df.groupBy(*by, week).agg(F.count(F.lit(1)).alias("_n"))
    both = null_safe_join(data.df, sizes, [*by, week])
    early = F.col("_pos") <= F.floor(F.col("_n") / 2)
    first, second = F.when(early, F.col(value)), F.when(~early, F.col(value))
    stats = both.groupBy(*by, week).agg(
        F.count(first).alias("n1"), F.avg(first).alias("mean1"), F.var_samp(first).alias("var1"),
        F.count(second).alias("n2"), F.avg(second).alias("mean2"), F.var_samp(second).alias("var2"))
    out = _z_columns(stats, delta).withColumn("drift_occurrences", F.col("drift_detected").cast("long"))
    return out.select(*by, week, "estimation", "z_score", "z_threshold", "drift_detected", "warning_detected", "drift_occurrences")


def confirm(df: DataFrame, k: int = 2, n: int = 2, by: Sequence[str] = ("method",), week: str = "week",
            flag: str = "raw_flag", reset: bool = False) -> DataFrame:
    """Adds ``confirmed_flag``: the raw flag fired in at least k of the last n windows.

    The input has one row per (method, week). Without reset this is a trailing frame. With ``reset`` a
    confirmation clears the history, as a retrain follows it; that is a fold over the method's few weeks.
    """
    if k > n:
        raise ValueError("k must not exceed n")
    fired = F.col(flag).cast("int")
    if not reset:
        w = Window.partitionBy(*by).orderBy(week).rowsBetween(-(n - 1), 0)
        return df.withColumn("confirmed_flag", F.sum(fired).over(w) >= k)
    history = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(week).alias("w"), fired.alias("f")))).alias("_h"))
    start = F.struct(F.array().cast("array<int>").alias("recent"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        recent = F.concat(acc["recent"], F.array(x["f"]))
        recent = F.slice(recent, F.greatest(F.lit(1), F.size(recent) - n + 1), n)
        hit = F.aggregate(recent, F.lit(0), lambda a, v: a + v) >= k
        kept = F.when(hit, F.array().cast("array<int>")).otherwise(recent)
        return F.struct(kept.alias("recent"), F.concat(acc["out"], F.array(hit)).alias("out"))

    folded = history.withColumn("_out", F.aggregate("_h", start, step, lambda acc: acc["out"]))
    flags = folded.select(*by, F.explode(F.arrays_zip(F.col("_h.w").alias("w"), F.col("_out").alias("o"))).alias("_z"))
    flags = flags.select(*by, F.col("_z.w").alias(week), F.col("_z.o").alias("confirmed_flag"))
    return null_safe_join(df, flags, [*by, week])


def combine_flags(results: DataFrame, weeks: DataFrame, methods: Sequence[str], k: int = 2, n: int = 2,
                  reset: bool = False) -> DataFrame:
    """Raw and confirmed flags for every (week, method); a method that did not run is false.

    ``results`` is (week, method, raw_flag); the grid of weeks and methods is small by nature.
    """
    grid = weeks.select("week").distinct().withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    filled = grid.join(results.select("week", "method", "raw_flag"), ["week", "method"], "left").fillna(False, ["raw_flag"])
    return confirm(filled, k, n, reset=reset)


# Own wording: what a confirmed trigger of each method says. {x} is a number of the row, {x:d} a count, {x:%} a share;
# {names} lists the features.
TRIGGERS = {
    "ks_stats": "{crossed:d} of {monitored:d} features ({share:%}) moved by the KS test after false discovery control, with a gap of {min_effect} or more; {bar:%} were enough. Features: {names}",
    "psi": "{crossed:d} of {monitored:d} features ({share:%}) have a PSI of {min_psi} or more and above what resampling gives; {bar:%} were enough. Features: {names}",
    "kl_divergence": "{crossed:d} of {monitored:d} features ({share:%}) have a Jensen-Shannon distance of {min_distance} or more; {bar:%} were enough. Features: {names}",
    "shap": "{crossed:d} of {monitored:d} features ({share:%}) changed their attributions; {bar:%} were enough. Features: {names}",
    "ddm": "The balanced error rate {error_rate} went above {drift_level}, three deviations over its lowest {lowest}",
    "eddm": "The distance between errors {distance} fell to {ratio} of its largest {largest}; below {min_ratio} is drift",
    "hddm": "The mean error {mean_error} left the reference mean {reference_mean} by more than the bound {bound}",
    "adwin": "Means {early_mean} and {late_mean} differ by z = {z}, above {threshold}",
    "prequential_auc": "The AUC went from {reference_auc} to {current_auc}, a fall of {fall} with a standard error of {se}; more than {min_fall} is drift",
    "clustering": "Rows lie {ratio} times as far from their centres as before (limit {max_ratio}); the PSI of the clusters is {cluster_psi} (limit {max_psi})",
    "autoencoder": "The reconstruction error rose from {reference_rmse} to {current_rmse}, z = {z}, above {threshold}",
    "champion_vs_challenger": "The challenger has an AUC of {challenger_auc}, the champion {champion_auc}: a lead of {gap} with a standard error of {se}; the champion lost {degradation}",
}
GATE = ". It fired in {fired:d} of the last {window_len:d} windows."
SLOT = re.compile(r"\{(\w+)(?::([d%]))?\}")


def slots(template: str) -> list[tuple[str, str, str]]:
    """(text before, name, format) of each slot, and the text behind the last one with an empty name."""
    out, at = [], 0
    for m in SLOT.finditer(template):
        out.append((template[at:m.start()], m[1], m[2] or "f"))
        at = m.end()
    return [*out, (template[at:], "", "")]


def _only(numbers: str, names: list[str]) -> Column:
    return F.map_filter(numbers, lambda k, v: k.isin(names))


def explain_trigger(df: DataFrame, numbers: str = "numbers", names: str = "names") -> DataFrame:
    """Adds ``reason``, a sentence with all its numbers, and ``metrics``, the method's numbers by name.

    ``df`` has one row per confirmed (week, method) with a map of numbers, an array of feature names, ``fired`` and
    ``window_len``. A number that is missing reads as n/a; another method has only the last sentence.
    """
    def written(template: str, number) -> Column:
        parts = []
        for text, name, form in slots(template):
            parts.append(F.lit(text))
            if name == "names":
                parts.append(F.array_join(F.coalesce(names, F.array().cast("array<string>")), ", "))
            elif name:
                x = number(name)
                shown = {"f": F.format_string("%.4f", x), "d": x.cast("long").cast("string"), "%": F.format_string("%.1f%%", 100.0 * x)}[form]
                parts.append(F.when(x.isNull(), "n/a").otherwise(shown))
        return F.concat(*parts)

    reason, kept = F.lit("Drift was confirmed"), F.create_map().cast("map<string,double>")
    for method, template in TRIGGERS.items():
        own = [name for _, name, _ in slots(template) if name not in ("", "names")]
        reason = F.when(F.col("method") == method, written(template, lambda n: F.try_element_at(numbers, F.lit(n)))).otherwise(reason)
        kept = F.when(F.col("method") == method, _only(numbers, own)).otherwise(kept)
    gate = written(GATE, lambda n: F.col(n).cast("double"))
    return df.withColumn("reason", F.concat(reason, gate)).withColumn("metrics", kept)
