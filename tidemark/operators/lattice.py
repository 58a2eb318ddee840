"""Adaptation states (full retrain week, partial update week, blend weight) and action logs replayed over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.models import partial_update, train_mlp
from tidemark.operators.performance import auc_each, f1_each, tune_threshold
from tidemark.plans.checkpoints import drop_stable, stable
from tidemark.plans.ordered import null_safe_join, with_each
from tidemark.plans.pool import run_pool

# Fixed values of the adaptation setting.
ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)
PARTIAL_WINDOW = 4
COSTS = {"none": 0.0, "partial": 0.0010, "full": 0.0040, "hedge": 0.0}
REWARD_SCALE = 100.0
STATE = ("full_week", "partial_week", "alpha", "week")


def train_lattice(rows: DataFrame, cols: Sequence[str], label: str, key: str, week: str = "week", hidden: Sequence[int] = (256, 128, 64), max_iter: int = 60,
                  window: int = PARTIAL_WINDOW, pool: int | None = None) -> DataFrame:
    """(full_week, partial_week, week, key, label, score, threshold, baseline) of every adaptation state on every later week.

    A full model is trained through each week but the last; a partial update continues it on the ``window`` weeks up to a later week, never
    on weeks that the full model has seen. Each model has its own threshold, the best on its last own week. Models are fitted a few at a time
    (``run_pool``): first the full ones, then all updates; the states' scores are written once. Weeks x weeks models are the bound.
    The baseline is the score of the full model of week 0 (null without that week); it goes with the rows, so that no blend has to look it up.
    """
    spark = rows.sparkSession
    weeks = sorted(r[0] for r in rows.select(week).distinct().collect())
    fulls = weeks[:-1]
    through = dict(zip(fulls, run_pool(spark, lambda f: train_mlp(rows.filter(F.col(week) <= f), cols, label, key, hidden, max_iter=max_iter), fulls, pool)))
    states = [(f, None) for f in fulls] + [(f, p) for f in fulls for p in fulls if p > f]
    after = rows.filter(F.col(week) > weeks[0])
    base = through[0].score(after, "baseline") if 0 in through else after.withColumn("baseline", F.lit(None).cast("double"))
    held = stable(base.select(key, week, label, *cols, "baseline"))

    def scored(state: tuple[int, int | None]) -> DataFrame:
        f, p = state
        model = through[f] if p is None else partial_update(through[f], rows.filter(F.col(week).between(max(f + 1, p - window + 1), p)), label)
        own = model.score(rows.filter(F.col(week) == (f if p is None else p))).select(F.col(label).cast("int").alias("label"), "score")
        best = tune_threshold(own, []).first()
        bar = float(best["threshold"]) if best is not None and best["threshold"] is not None else 0.5
        later = held.filter(F.col(week) > (f if p is None else p))
        later = later.withColumn("score", F.col("baseline")) if state == (0, None) else model.score(later)
        return stable(later.select(F.lit(f).cast("long").alias("full_week"), F.lit(p).cast("long").alias("partial_week"), F.col(week).cast("long").alias("week"), key,
                                   F.col(label).cast("int").alias("label"), "score", F.lit(bar).alias("threshold"), "baseline"))
    out = reduce(DataFrame.unionByName, run_pool(spark, scored, states, pool))
    drop_stable(held)
    return out


def blend_scores(scored: DataFrame, key: str = "row_id", alphas: Sequence[float] = ALPHAS, nested: bool = False) -> DataFrame:
    """(full_week, partial_week, week, key, label, score) -> one row per alpha with alpha*score + (1-alpha)*baseline; ``nested`` keeps the rows as
    they are, with an array ``scores`` in the order of ``alphas``.

    The baseline is the state (0, null) of the same row: the ``baseline`` column where there is one, else it is looked up. Only weeks after the
    state's training data count.
    """
    valid = scored.filter((F.col("week") > F.col("full_week")) & (F.col("week") > F.coalesce("partial_week", F.lit(-1))))
    if "baseline" in scored.columns:
        both = valid.withColumnRenamed("baseline", "_base")
    else:
        base = (scored.filter((F.col("full_week") == 0) & F.col("partial_week").isNull())
                .select(F.col("week").alias("_w"), F.col(key).alias("_k"), F.col("score").alias("_base")))
        both = valid.join(base, (valid["week"] == base["_w"]) & (valid[key] == base["_k"]), "left").drop("_w", "_k")
    blend = lambda a: F.when(F.col("_base").isNull(), F.col("score")).otherwise(a * F.col("score") + (1 - a) * F.col("_base"))
    if nested:
        return both.withColumn("scores", F.array(*[blend(F.lit(a)) for a in alphas])).drop("_base", "score")
    return both.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas]))).withColumn("score", blend(F.col("alpha"))).drop("_base")


def lattice_performance(blended: DataFrame, threshold: str | float = 0.5, chunks: int | None = None, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """AUC and F1 per (full_week, partial_week, alpha, week) of nested blends over ``alphas``; one class leaves AUC null."""
    by, cut = [c for c in STATE if c != "alpha"], F.col(threshold) if isinstance(threshold, str) else float(threshold)
    ranked = auc_each(blended, by, "label", "scores", chunks, "_a")
    ranked = ranked.select(*by, "_a", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("auc")).alias("auc"))
    both = null_safe_join(ranked, f1_each(blended, by, "label", "scores", len(alphas), cut, "_a"), [*by, "_a"])
    alpha = F.get(F.array(*[F.lit(a) for a in alphas]), F.col("_a")).alias("alpha")
    return both.select("full_week", "partial_week", alpha, "week", "auc", "f1")


def forgetting_cost(lattice: DataFrame) -> DataFrame:
    """Best-blend AUC minus the AUC of trusting the update alone, with the smallest best alpha; costs above 0."""
    by = ["full_week", "partial_week", "week"]
    best = lattice.filter(F.col("auc").isNotNull()).groupBy(*by).agg(
        F.max(F.struct("auc", (-F.col("alpha")).alias("neg"))).alias("_b"), F.max(F.when(F.col("alpha") == 1.0, F.col("auc"))).alias("_one"))
    cost = F.col("_b.auc") - F.coalesce("_one", F.col("_b.auc"))
    return (best.select(*by, cost.alias("cost"), (-F.col("_b.neg")).alias("best_alpha"), F.col("_b.auc").alias("best_auc"))
            .filter("cost > 0").orderBy(F.desc("cost"), *by))


def replay_actions(actions: DataFrame, by: Sequence[str] = ("policy",)) -> DataFrame:
    """State after each week's action: last full week, last partial since it, alpha (a step down per hedge since it)."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    full = F.coalesce(F.max(F.when(F.col("action") == "full", F.col("week"))).over(w), F.lit(0))
    out = actions.withColumn("full_week", full)
    s = Window.partitionBy(*by, "full_week").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    partial = F.max(F.when((F.col("action") == "partial") & (F.col("week") > F.col("full_week")), F.col("week"))).over(s)
    steps = F.count_if((F.col("action") == "hedge") & (F.col("week") > F.col("full_week"))).over(s)
    return out.withColumn("partial_week", partial).withColumn("alpha", F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.25) * steps))


def score_actions(actions: DataFrame, lattice: DataFrame, by: Sequence[str] = ("policy",)) -> DataFrame:
    """Outcome of each action on the following week: partial state, else the full one, else the baseline.

    The reward is 100 * (AUC next week - never-retrain AUC - action cost); the last week has no outcome.
    """
    by = list(by)
    states = replay_actions(actions, by)
    following = F.lead("week").over(Window.partitionBy(*by).orderBy("week"))
    states = states.withColumn("next_week", following).filter(F.col("next_week").isNotNull())
    cells = stable(lattice.filter(F.col("auc").isNotNull()).select(*STATE, "auc", "f1"))  # weeks x weeks x alphas rows, worked out once for three lookups

    def look(name: str, alpha: str = "alpha"):
        return F.broadcast(cells.select(F.col("full_week").alias(f"{name}f"), F.col("partial_week").alias(f"{name}p"), F.col("alpha").alias(f"{name}a"),
                                        F.col("week").alias(f"{name}w"), F.col("auc").alias(f"{name}auc"), F.col("f1").alias(f"{name}f1")))

    one, two = look("_1"), look("_2").filter(F.col("_2p").isNull())
    base = look("_0").filter((F.col("_0f") == 0) & F.col("_0p").isNull() & (F.col("_0a") == 1.0)).select("_0w", "_0auc")
    out = states.join(one, (F.col("full_week") == F.col("_1f")) & F.col("partial_week").eqNullSafe(F.col("_1p"))
                      & (F.col("alpha") == F.col("_1a")) & (F.col("next_week") == F.col("_1w")), "left")
    out = out.join(two, (F.col("full_week") == F.col("_2f")) & (F.col("alpha") == F.col("_2a")) & (F.col("next_week") == F.col("_2w")), "left")
    out = out.join(base, F.col("next_week") == F.col("_0w"), "left")
    zero = F.coalesce("_0auc", F.lit(0.5))
    value = F.coalesce("_1auc", "_2auc", zero)
    f1 = F.when(F.col("_1auc").isNotNull(), F.col("_1f1")).when(F.col("_2auc").isNotNull(), F.col("_2f1")).otherwise(F.lit(0.0))
    cost = F.coalesce(*[F.when(F.col("action") == a, F.lit(c)) for a, c in COSTS.items()])
    return out.select(*by, F.col("week").alias("acted_week"), F.col("next_week").alias("week"), "action", "full_week", "partial_week", "alpha",
                      value.alias("auc"), f1.alias("f1"), (value - zero).alias("auc_delta"), (REWARD_SCALE * (value - zero - cost)).alias("reward"))


def summarise_rewards(outcomes: DataFrame, by: Sequence[str] = ("policy",)) -> DataFrame:
    """Totals, means, worst week and counts of each action."""
    n = lambda a: F.count_if(F.col("action") == a)
    return outcomes.groupBy(*by).agg(F.sum("reward").alias("total_reward"), F.avg("auc").alias("mean_auc"), F.min("auc").alias("min_auc"),
                                     F.avg("f1").alias("mean_f1"), n("full").alias("full_retrains"), n("partial").alias("partial_updates"), n("hedge").alias("hedges"))


def fixed_schedule(weeks: DataFrame, period: int) -> DataFrame:
    """Full retrain on every week divisible by ``period``."""
    return weeks.select(F.lit(f"fixed_schedule_every_{period}w").alias("policy"), "week",
                        F.when(F.col("week") % period == 0, "full").otherwise("none").alias("action"))


def constant_action(weeks: DataFrame, action: str, name: str) -> DataFrame:
    return weeks.select(F.lit(name).alias("policy"), "week", F.lit(action).alias("action"))


def detector_actions(retrains: DataFrame, grid: DataFrame) -> DataFrame:
    """(policy, week) retrains as full-retrain actions over a (policy, week) grid."""
    marks = retrains.select("policy", "week").distinct().withColumn("_hit", F.lit(True))
    return grid.join(marks, ["policy", "week"], "left").select(
        "policy", "week", F.when(F.col("_hit"), "full").otherwise("none").alias("action"))


def random_action_control(summary: DataFrame, lattice: DataFrame, weeks: DataFrame, n_samples: int = 200, seed: int = 42) -> DataFrame:
    """Each policy against random placements of the same numbers of full and partial actions."""
    from tidemark.operators.policies import random_retrains
    budgets = summary.select("policy", (F.col("full_retrains") + F.col("partial_updates")).alias("n_retrains"), "full_retrains", "mean_auc")
    drawn = random_retrains(budgets, weeks, n_samples, seed).join(F.broadcast(budgets.select("policy", "full_retrains")), "policy")
    acts = drawn.select("policy", "sample", "week", F.when(F.col("position") <= F.col("full_retrains"), "full").otherwise("partial").alias("action"))
    grid = with_each(drawn.select("policy", "sample").distinct(), weeks.select("week"))
    log = grid.join(acts, ["policy", "sample", "week"], "left").fillna("none", ["action"])
    runs = summarise_rewards(score_actions(log, lattice, ("policy", "sample")), ("policy", "sample"))
    both = runs.select("policy", F.col("mean_auc").alias("_r")).join(F.broadcast(budgets.select("policy", "mean_auc")), "policy")
    return both.groupBy("policy").agg(F.avg((F.round("mean_auc", 9) >= F.round("_r", 9)).cast("double")).alias("random_control_pct"),
                                      F.avg("_r").alias("random_control_mean_auc"), F.count(F.lit(1)).alias("n_samples"))
