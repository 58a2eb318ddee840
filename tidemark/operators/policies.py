"""Model versions, adoption, and retraining policies compared over one table of version scores.

A version is named by the last week it was trained through. Tables here have one row per (method, week) or
(version, week), so their size follows the number of windows, not the number of events.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.performance import auc, f1_at
from tidemark.plans.ordered import null_safe_join, with_each


def missing_versions(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """Weeks that need a model and have none: at most one fit per week, whoever asks."""
    return wanted.select(F.col("week").alias("trained_through_week")).distinct().join(
        versions.select("trained_through_week"), "trained_through_week", "left_anti")


def get_or_train(wanted: DataFrame, versions: DataFrame, train: Callable[[int], DataFrame]) -> DataFrame:
    """Train the missing weeks, one Spark job each, and return the version table with their rows."""
    out = versions
    for row in missing_versions(wanted, versions).orderBy("trained_through_week").toLocalIterator():
        out = out.unionByName(train(int(row[0])))
    return out


def adopt(triggers: DataFrame) -> DataFrame:
    """Adoption log from (method, week, reason): from the version held before, to the one trained at ``week``."""
    w = Window.partitionBy("method").orderBy("week")
    before = F.coalesce(F.lag("week").over(w), F.lit(0))
    return triggers.select("method", "week", before.cast("long").alias("from_version"), F.col("week").cast("long").alias("to_version"), "reason",
                           F.row_number().over(w).alias("retrain_count"))


def version_in_force(adoptions: DataFrame, weeks: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, week, version): the last adoption strictly before the week, else the baseline 0."""
    grid = with_each(methods.select("method"), weeks.select("week"))
    marks = adoptions.select("method", F.col("week"), F.col("to_version").alias("_to"))
    w = Window.partitionBy("method").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    both = grid.join(marks, ["method", "week"], "left")
    return both.select("method", "week", F.coalesce(F.last("_to", ignorenulls=True).over(w), F.lit(0)).cast("long").alias("version"))


def sharing_summary(adoptions: DataFrame, n_methods: int) -> DataFrame:
    """Distinct models against the number a per-method design would have trained."""
    distinct = F.count_distinct("to_version") + 1
    naive = F.count_distinct("method", "to_version") + F.lit(n_methods)
    return adoptions.agg(distinct.alias("distinct_models"), naive.alias("naive_models")).withColumn(
        "reduction_ratio", F.col("naive_models") / F.col("distinct_models"))


def performance_matrix(scored: DataFrame, version: str = "version", week: str = "week", label: str = "label",
                       score: str = "score", threshold: str = "threshold", chunks: int | None = None) -> DataFrame:
    """Out-of-sample AUC and F1 of every version on every later week (in-sample cells are absent).

    A week with one class has a null AUC.
    """
    later = scored.filter(F.col(week) > F.col(version))
    ranked = auc(later, [version, week], label, score, chunks)
    ranked = ranked.select(version, week, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("auc")).alias("auc"))
    f1 = f1_at(later, [version, week], label, score, F.col(threshold)).select(version, week, "f1")
    return null_safe_join(ranked, f1, [version, week])


def pivot_matrix(matrix: DataFrame, weeks: Sequence[int] | None = None, value: str = "auc", version: str = "version", week: str = "week") -> DataFrame:
    """One row per version, one column per week: those given, or all weeks of the table."""
    return matrix.groupBy(version).pivot(week, None if weeks is None else list(weeks)).agg(F.first(value))


def policy_from_retrains(retrains: DataFrame, grid: DataFrame, by: Sequence[str] = ("policy",)) -> DataFrame:
    """(policy, week, version) from (policy, week) retrains: a retrain serves only the weeks after it."""
    marks = retrains.select(*by, "week").distinct().withColumn("_hit", F.col("week"))
    w = Window.partitionBy(*by).orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    return (grid.join(marks, [*by, "week"], "left")
            .select(*by, "week", F.coalesce(F.max("_hit").over(w), F.lit(0)).cast("long").alias("version")))


def reference_policies(weeks: DataFrame) -> DataFrame:
    """never_retrain and always_retrain as (policy, week, version)."""
    w = Window.orderBy("week")
    always = weeks.select(F.lit("always_retrain").alias("policy"), "week", F.coalesce(F.lag("week").over(w), F.lit(0)).cast("long").alias("version"))
    return weeks.select(F.lit("never_retrain").alias("policy"), "week", F.lit(0).cast("long").alias("version")).unionByName(always)


def evaluate_policies(in_force: DataFrame, matrix: DataFrame, by: Sequence[str] = ("policy",)) -> DataFrame:
    """Mean and worst AUC and F1 of each policy, how many retrains served, weeks covered and missing."""
    cells = F.broadcast(matrix.select("version", "week", "auc", "f1", F.lit(True).alias("_have")))
    read = in_force.join(cells, ["version", "week"], "left")
    return read.groupBy(*by).agg(
        F.count_distinct(F.when(F.col("version") > 0, F.col("version"))).alias("n_retrains"),
        F.avg("auc").alias("mean_auc"), F.min("auc").alias("min_auc"), F.avg("f1").alias("mean_f1"), F.min("f1").alias("min_f1"),
        F.count("auc").alias("weeks_evaluated"), F.count_if(F.col("_have").isNull()).alias("weeks_unavailable"))


def random_retrains(budgets: DataFrame, weeks: DataFrame, n_samples: int = 200, seed: int = 42) -> DataFrame:
    """(policy, sample, week, position): the ``n_retrains`` lowest-hashed weeks of each sample.

    The hash is of (sample, week), so equal budgets share their samples; ``position`` orders the draw.
    """
    samples = weeks.select("week").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    w = Window.partitionBy("sample").orderBy(F.md5(F.concat_ws(":", F.col("sample").cast("string"), F.col("week").cast("string"), F.lit(str(seed)))), "week")
    drawn = samples.withColumn("position", F.row_number().over(w))
    return drawn.join(F.broadcast(budgets.filter("n_retrains > 0").select("policy", "n_retrains")), F.col("position") <= F.col("n_retrains")).drop("n_retrains")


def random_control(evaluated: DataFrame, matrix: DataFrame, weeks: DataFrame, n_samples: int = 200, seed: int = 42) -> DataFrame:
    """Each policy against random policies with as many retrains: percentile, mean, beats (>= 0.95).

    All samples of all policies are one job. No retrain means no control, hence null. Means are compared at nine
    digits, as equal policies may add their weeks in another order.
    """
    drawn = random_retrains(evaluated, weeks, n_samples, seed)
    grid = with_each(drawn.select("policy", "sample").distinct(), weeks.select("week"))
    forced = policy_from_retrains(drawn, grid, ("policy", "sample"))
    scores = evaluate_policies(forced, matrix, ("policy", "sample")).select("policy", "sample", F.col("mean_auc").alias("_r"))
    both = evaluated.select("policy", "mean_auc").join(scores.filter(F.col("_r").isNotNull()), "policy", "left")
    out = both.groupBy("policy").agg(
        F.avg(F.when(F.col("_r").isNotNull() & F.col("mean_auc").isNotNull(), (F.round("mean_auc", 9) >= F.round("_r", 9)).cast("double"))).alias("random_control_percentile"),
        F.avg(F.when(F.col("mean_auc").isNotNull(), F.col("_r"))).alias("random_control_mean_auc"), F.count("_r").alias("n_samples"))
    return out.withColumn("beats_random_control", F.col("random_control_percentile") >= 0.95)


def agreement_jaccard(flags: DataFrame, flag: str = "confirmed_flag") -> DataFrame:
    """Pairwise Jaccard of the weeks two methods flagged; empty union is null, a method with itself is 1."""
    hits = flags.filter(F.col(flag)).select("method", "week").distinct()
    names = flags.select("method").distinct()
    size = hits.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    sized = names.join(size, "method", "left").fillna(0, ["n"])
    a, b = sized.select(F.col("method").alias("method_a"), F.col("n").alias("_a")), sized.select(F.col("method").alias("method_b"), F.col("n").alias("_b"))
    both = (hits.withColumnRenamed("method", "method_a").join(hits.withColumnRenamed("method", "method_b"), "week")
            .groupBy("method_a", "method_b").agg(F.count(F.lit(1)).alias("_i")))
    # Method pairs: a dozen names squared.
    pairs = with_each(a, b).join(both, ["method_a", "method_b"], "left").fillna(0, ["_i"])
    union = F.col("_a") + F.col("_b") - F.col("_i")
    j = F.when(F.col("method_a") == F.col("method_b"), 1.0).otherwise(F.try_divide(F.col("_i").cast("double"), union))
    return pairs.select("method_a", "method_b", j.alias("jaccard"))


# Policies counted as classical detectors; fixed values of the comparison.
CLASSICAL = ("adwin", "prequential_auc", "eddm", "champion_vs_challenger", "ks_stats", "kl_divergence", "psi", "shap")


def gain_decomposition(policies: DataFrame, cheap: str = "always_partial_update", learned: str = "rl_agent_greedy") -> DataFrame:
    """Best classical AUC, the gain from a cheap action, the gain from the learned policy, and the first's share."""
    pick = lambda p: F.max(F.when(F.col("policy") == p, F.col("mean_auc")))
    out = policies.agg(F.max(F.when(F.col("policy").isin(*CLASSICAL), F.col("mean_auc"))).alias("best_classical"),
                       pick(cheap).alias("_cheap"), pick(learned).alias("_learned"))
    total = F.col("_learned") - F.col("best_classical")
    share = F.coalesce(F.try_divide(100 * (F.col("_cheap") - F.col("best_classical")), total), F.lit(0.0))
    return out.select("best_classical", (F.col("_cheap") - F.col("best_classical")).alias("action_gain"),
                      (F.col("_learned") - F.col("_cheap")).alias("policy_gain"), total.alias("total_gain"), share.alias("action_share_pct"))
