"""Report tables over per-week results. Inputs have one row per (week, method) or (week, feature)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import normal_cut
from tidemark.plans.ordered import attach_row, with_each

VOTE_METHODS = ("ks_stats", "psi", "kl_divergence", "shap")


def week_method_matrix(flags: DataFrame, votes: DataFrame, metrics: DataFrame, triggers: DataFrame) -> DataFrame:
    """One row per (week, method).

    flags (week, method, model_version, raw_flag, confirmed_flag), votes (week, method, feature, drift),
    metrics (week, method, value, threshold), triggers (week, method).
    """
    names = votes.groupBy("week", "method").agg(
        F.count(F.lit(1)).alias("features_total"), F.count_if("drift").alias("features_crossed"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("drift"), F.col("feature")))), ";").alias("drifted_feature_names"))
    out = flags.join(names, ["week", "method"], "left").join(
        metrics.select("week", "method", F.col("value").alias("key_metric_value"), F.col("threshold").alias("key_metric_threshold")), ["week", "method"], "left")
    out = out.join(triggers.select("week", "method").distinct().withColumn("_t", F.lit(True)), ["week", "method"], "left")
    return out.select("week", "method", "model_version", "raw_flag", "confirmed_flag", F.coalesce("_t", F.lit(False)).alias("retrained_this_week"),
                      "features_total", "features_crossed", (F.col("features_crossed") / F.col("features_total")).alias("features_crossed_fraction"),
                      "drifted_feature_names", "key_metric_value", "key_metric_threshold")


def weekly_flat_report(matrix: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per week with a drift and a version column per method and the triggering methods."""
    short = {m: m.replace("champion_vs_challenger", "champ_chall") for m in methods}
    cells = [a for m in methods for a in (
        F.coalesce(F.max(F.when(F.col("method") == m, F.col("confirmed_flag"))), F.lit(False)).alias(f"{short[m]}_drift"),
        F.max(F.when(F.col("method") == m, F.col("model_version"))).alias(f"{short[m]}_version"))]
    hit = F.col("retrained_this_week")
    return matrix.groupBy("week").agg(
        F.lit("Inference").alias("event"), F.max("confirmed_flag").alias("overall_drift"), *cells,
        F.count_if(hit).alias("retrain_count"), F.array_join(F.array_sort(F.collect_list(F.when(hit, F.col("method")))), ";").alias("triggered_methods"),
        F.max(hit.cast("int")).alias("models_trained_this_week"))


# Default thresholds of the recompute rules; fixed values.
RULES = {"ks_alpha": 0.05, "psi_warning": 0.10, "psi_drift": 0.20, "kl_drift": 0.50, "ddm_warning": 2.0, "ddm_drift": 3.0,
         "eddm_warning": 0.95, "eddm_drift": 0.90, "adwin_delta": 0.002, "shap_alpha": 0.05, "distance_ratio": 1.5,
         "cluster_psi": 0.20, "z_score": 3.0, "auc_degradation": 0.05, "auc_gap": 0.03}


def recompute_features(features: DataFrame, method: str, **over: float) -> DataFrame:
    """Drift per feature from the stored metric, ignoring the extra gates of the live rule."""
    r = {**RULES, **over}
    drift = {"ks_stats": F.col("ks_p") < r["ks_alpha"], "psi": F.col("psi") >= r["psi_drift"],
             "kl_divergence": F.col("kl_div") >= r["kl_drift"], "shap": F.col("shap_p") < r["shap_alpha"]}[method]
    warn = (F.col("psi") >= r["psi_warning"]) & ~drift if method == "psi" else F.lit(False)
    return features.withColumn("drift", F.coalesce(drift, F.lit(False))).withColumn("warning", F.coalesce(warn, F.lit(False)))


def recompute(stored: DataFrame, method: str, **over: float) -> DataFrame:
    """Drift and warning per week from the stored stream or model metrics."""
    r = {**RULES, **over}
    c = F.col
    if method == "ddm":
        hi, lo = c("p_min") + r["ddm_drift"] * c("s_min"), c("p_min") + r["ddm_warning"] * c("s_min")
        drift, warn = c("mean_error_rate") > hi, c("mean_error_rate") > lo
    elif method == "eddm":
        drift = (c("max_metric") > 0) & (c("metric_value") < r["eddm_drift"] * c("max_metric"))
        warn = (c("max_metric") > 0) & (c("metric_value") < r["eddm_warning"] * c("max_metric")) & ~drift
    elif method == "adwin":
        drift, warn = c("z_score") > normal_cut(r["adwin_delta"]), F.lit(False)
    elif method == "clustering":
        drift = (c("distance_ratio") >= r["distance_ratio"]) | (c("cluster_psi") >= r["cluster_psi"])
        warn = ((c("distance_ratio") >= r["distance_ratio"] * 0.8) | (c("cluster_psi") >= r["cluster_psi"] * 0.5)) & ~drift
    elif method == "autoencoder":
        drift = c("mse_z_score") > r["z_score"]
        warn = (c("mse_z_score") > r["z_score"] * 0.67) & ~drift
    elif method == "champion_vs_challenger":
        fall = F.coalesce("auc_degradation", F.lit(0.0))
        drift = (fall > r["auc_degradation"]) | (c("auc_gap") > r["auc_gap"])
        warn = ((fall > r["auc_degradation"] * 0.5) | (c("auc_gap") > r["auc_gap"] * 0.5)) & ~drift
    else:
        raise ValueError(f"no recompute rule for {method!r}")
    return stored.withColumn("drift", drift).withColumn("warning", warn)


def weekly_gate_log(features: DataFrame, retrains: DataFrame, gate: float, value: str = "value", drift: str = "drift") -> DataFrame:
    """Per week: largest metric, n/N crossed, gate met, retrained, and the reason in words.

    features (week, feature, value, drift); retrains (week, retrain_count) of one method.
    """
    agg = features.groupBy("week").agg(F.round(F.max(value), 4).alias("max_value"), F.count_if(drift).alias("crossed"), F.count(F.lit(1)).alias("total"))
    out = agg.join(retrains.select("week", "retrain_count"), "week", "left")
    share = F.col("crossed") / F.col("total")
    pct = F.concat(F.round(share * 100, 0).cast("int").cast("string"), F.lit("%"))
    count = F.concat(F.col("crossed").cast("string"), F.lit("/"), F.col("total").cast("string"))
    bar = f"{gate:.0%}"
    text = (F.when(F.col("retrain_count").isNotNull(), F.concat(count, F.lit(" features ("), pct, F.lit(f") drifted, {bar} gate met, retrained (#"), F.col("retrain_count").cast("string"), F.lit(")")))
            .when(share >= gate, F.concat(count, F.lit(" features ("), pct, F.lit(") drifted, gate met, no retrain recorded")))
            .otherwise(F.concat(F.lit("Only "), count, F.lit(" features ("), pct, F.lit(f") drifted, below the {bar} gate"))))
    return out.select("week", "max_value", count.alias("features_drifted"), (share >= gate).alias("gate_met"),
                      F.col("retrain_count").isNotNull().alias("retrained"), text.alias("explanation"))


def method_summary(flags: DataFrame, triggers: DataFrame, scores: DataFrame, week: int) -> DataFrame:
    """Status of each method at ``week``: retrains so far, drift, last retrain, AUC, F1."""
    past = triggers.groupBy("method").agg(F.count_if(F.col("week") <= week).alias("retrains"), F.max("week").alias("last_retrain"))
    now = flags.filter(F.col("week") == week).select("method", F.col("confirmed_flag").alias("drift"))
    out = now.join(past, "method", "left").join(scores.filter(F.col("week") == week).select("method", "auc", "f1"), "method", "left")
    return out.select("method", F.coalesce("retrains", F.lit(0)).alias("retrains"), F.when(F.col("drift"), "DRIFT").otherwise("OK").alias("status"), "last_retrain", "auc", "f1")


def feature_method_grid(votes: DataFrame, flags: DataFrame, week: int, methods: Sequence[str]) -> DataFrame:
    """Features by methods at ``week``: a vote method shows the feature's own drift, another its confirmed flag."""
    own = votes.filter(F.col("week") == week)
    shared = flags.filter((F.col("week") == week) & ~F.col("method").isin(*VOTE_METHODS)).select("method", F.col("confirmed_flag").alias("drift"))
    rows = own.select("feature", "method", "drift").unionByName(with_each(own.select("feature").distinct(), shared))
    return rows.groupBy("feature").agg(*[F.coalesce(F.max(F.when(F.col("method") == m, F.col("drift").cast("int"))), F.lit(0)).alias(m) for m in methods])


def week_method_grid(matrix: DataFrame, weeks: Sequence[int] | None = None) -> DataFrame:
    """Methods by weeks: 0 quiet, 1 raw alarm, 2 confirmed; all weeks of the table unless some are given."""
    if weeks is None:  # one row per week
        weeks = sorted(r["week"] for r in matrix.select("week").distinct().collect())
    state = F.when(F.col("confirmed_flag"), 2).when(F.col("raw_flag"), 1).otherwise(0)
    return matrix.groupBy("method").agg(*[F.coalesce(F.max(F.when(F.col("week") == w, state)), F.lit(0)).alias(f"w{w}") for w in weeks])


def alarm_counts(matrix: DataFrame, flag: str = "confirmed_flag") -> DataFrame:
    """Flagged weeks per method; a quiet method shows 0."""
    return matrix.groupBy("method").agg(F.count_if(flag).alias("alarms"))


def retrain_counts(triggers: DataFrame, methods: DataFrame) -> DataFrame:
    """Retrains per method, zero-filled."""
    n = triggers.groupBy("method").agg(F.count(F.lit(1)).alias("retrains"))
    return methods.select("method").distinct().join(n, "method", "left").fillna(0, ["retrains"])


def top_drifting_features(matrix: DataFrame, n: int = 12, per_method: bool = False) -> DataFrame:
    """Features named most often by the voting methods; ties by name."""
    by = ["method"] if per_method else []
    rows = matrix.filter(F.col("method").isin(*VOTE_METHODS) & F.col("drifted_feature_names").isNotNull())
    names = rows.select(*by, F.explode(F.split("drifted_feature_names", ";")).alias("feature")).withColumn("feature", F.trim("feature")).filter("feature <> ''")
    counts = names.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("times"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("times"), "feature"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def contributor_frequency(top: DataFrame, n: int = 10) -> DataFrame:
    """How often a feature is among the top contributors and its summed shift.

    top is (week, contributors array<struct<feature, shift>>).
    """
    rows = top.select(F.explode("contributors").alias("c")).select("c.feature", "c.shift")
    out = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("times"), F.sum("shift").alias("shift_sum"))
    rank = F.row_number().over(Window.orderBy(F.desc("times"), F.desc("shift_sum"), "feature"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= n)


def feature_agreement_cosine(implicated: DataFrame, methods: DataFrame) -> DataFrame:
    """Cosine between the methods' feature counts; a method that named nothing is 0 with everyone.

    implicated is (method, feature), one row per time a method named a feature.
    """
    counts = implicated.groupBy("method", "feature").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norms = counts.groupBy("method").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    names = methods.select("method").distinct().join(norms, "method", "left")
    a = names.select(F.col("method").alias("method_a"), F.col("norm").alias("_na"))
    b = names.select(F.col("method").alias("method_b"), F.col("norm").alias("_nb"))
    left = counts.select("feature", F.col("method").alias("method_a"), F.col("n").alias("_x"))
    right = counts.select("feature", F.col("method").alias("method_b"), F.col("n").alias("_y"))
    dots = left.join(right, "feature").groupBy("method_a", "method_b").agg(F.sum(F.col("_x") * F.col("_y")).alias("_dot"))
    pairs = with_each(a, b).join(dots, ["method_a", "method_b"], "left")
    cos = F.coalesce(F.try_divide(F.coalesce("_dot", F.lit(0.0)), F.col("_na") * F.col("_nb")), F.lit(0.0))
    return pairs.select("method_a", "method_b", cos.alias("cosine"))


def cluster_composition(assigned: DataFrame, week: str = "week", cluster: str = "cluster") -> DataFrame:
    """Share of each cluster in each window; rows are counted before the shuffle."""
    n = assigned.groupBy(week, cluster).agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(week)))


def metric_trend(features: DataFrame, value: str) -> DataFrame:
    """Mean and maximum of a per-feature metric per week."""
    return features.groupBy("week").agg(F.avg(value).alias("mean_value"), F.max(value).alias("max_value"))


def mean_abs_shift(features: DataFrame, shift: str = "shift", n: int = 10) -> DataFrame:
    """Features with the largest mean absolute shift."""
    return features.groupBy("feature").agg(F.avg(F.abs(shift)).alias("mean_shift")).orderBy(F.desc("mean_shift"), "feature").limit(n)


def challenger_gap_counts(gaps: DataFrame, gap: str = "auc_gap") -> DataFrame:
    """Weeks in which a retrain would have helped and hurt."""
    return gaps.agg(F.count_if(F.col(gap) > 0).alias("would_help"), F.count_if(F.col(gap) < 0).alias("would_hurt"))


def feature_display_map(ranked: DataFrame) -> DataFrame:
    """(feature, rank) -> 'Feature n' labels by rank order."""
    return ranked.withColumn("label", F.concat(F.lit("Feature "), F.row_number().over(Window.orderBy("rank", "feature")).cast("string")))


def prettify(df: DataFrame, col: str, display: DataFrame) -> DataFrame:
    """Replace feature names in free text by their labels, longer names first.

    The display map has one entry per monitored feature. Names are first turned into private-use marks, so a label
    is never searched again.
    """
    entry = F.struct((-F.length("feature")).alias("l"), F.col("feature").alias("f"), F.col("label").alias("d"))
    one = display.agg(F.array_sort(F.collect_list(entry)).alias("_m"))
    mark = lambda i: F.concat(F.lit("\ue000"), i.cast("string"), F.lit("\ue001"))
    both = attach_row(df, one)
    index = F.transform("_m", lambda e, i: F.struct(e["f"].alias("f"), e["d"].alias("d"), mark(i).alias("k")))
    both = both.withColumn("_i", index)
    swap: Column = F.aggregate("_i", F.col(col), lambda acc, e: F.replace(acc, e["f"], e["k"]))
    both = both.withColumn(col, swap)
    return both.withColumn(col, F.aggregate("_i", F.col(col), lambda acc, e: F.replace(acc, e["k"], e["d"]))).drop("_m", "_i")

