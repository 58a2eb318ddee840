"""Choosing a stable, non-redundant set of features to monitor. Result tables have one row per feature."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.ranks import rank_products
from tidemark.operators.sampling import bootstrap_bags
from tidemark.plans.ordered import attach_row


def bagged_importance(df: DataFrame, cols: Sequence[str], key: str, fit: Callable[[DataFrame, str, int], Sequence[float]],
                      n_bags: int = 5, seed: int = 42) -> DataFrame:
    """(bag, feature, gain): one fit per bag, each on all rows with that bag's Poisson weights.

    ``fit(df, weight_column, seed)`` returns one importance per column.
    """
    bags = bootstrap_bags(df, n_bags, key, seed)
    rows = [(b, c, float(g)) for b in range(n_bags) for c, g in zip(cols, fit(bags, f"bag_{b}", seed + b))]
    return df.sparkSession.createDataFrame(rows, "bag int, feature string, gain double")


def rank_gains(gains: DataFrame, top_m: int = 25) -> DataFrame:
    """Adds the average rank within each bag (1 = largest gain) and whether the feature is in the bag's top m."""
    tie = Window.partitionBy("bag", "gain")
    by = Window.partitionBy("bag").orderBy(F.desc("gain"))
    first = Window.partitionBy("bag").orderBy(F.desc("gain"), "feature")
    return (gains.withColumn("rank", F.rank().over(by) + (F.count(F.lit(1)).over(tie) - 1) / 2)
            .withColumn("selected", (F.row_number().over(first) <= top_m).cast("int")))


def importance_summary(ranked: DataFrame) -> DataFrame:
    """Mean gain, its variation, mean reciprocal rank and selection frequency per feature."""
    out = ranked.groupBy("feature").agg(F.avg("gain").alias("mean_gain"), F.stddev_pop("gain").alias("_s"),
                                        F.avg(1 / F.col("rank")).alias("mean_reciprocal_rank"), F.avg("selected").alias("selection_frequency"))
    return out.withColumn("gain_cv", F.when(F.col("mean_gain") > 0, F.try_divide("_s", "mean_gain")).otherwise(0.0)).drop("_s")


def nogueira_stability(ranked: DataFrame) -> DataFrame:
    """Stability of the bags' selections (1 = identical, about 0 = chance), as one row."""
    per = ranked.groupBy("feature").agg(F.avg("selected").alias("p"), F.count(F.lit(1)).alias("_bags"))
    out = per.agg(F.count(F.lit(1)).alias("_d"), F.sum("p").alias("_k"), F.avg(F.col("p") * (1 - F.col("p"))).alias("_v"), F.max("_bags").alias("_b"))
    share = F.col("_k") / F.col("_d")
    spread = share * (1 - share)
    value = 1 - F.col("_b") / (F.col("_b") - 1) * F.col("_v") / spread
    return out.select(F.when((F.col("_b") < 2) | (spread <= 0), 1.0).otherwise(value).alias("stability"))


def monitorability(df: DataFrame, cols: Sequence[str], min_distinct: int = 10, min_std: float = 1e-8, approximate: bool = False) -> DataFrame:
    """Distinct values and sample deviation per column, and whether a distribution test can say anything.

    Exact distinct counts over many columns multiply the rows; ``approximate`` uses sketches in one pass.
    """
    count = F.approx_count_distinct if approximate else F.count_distinct
    if approximate:
        cells = df.agg(*[f(c).alias(f"{t}{i}") for i, c in enumerate(cols) for t, f in (("n", count), ("s", F.stddev_samp))])
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n_distinct"), F.col(f"s{i}").alias("std")) for i, c in enumerate(cols)])
        out = cells.select(F.explode(rows).alias("r")).select("r.*")
    else:
        # Values are counted once per (column, value) with partial combining, so no column is gathered.
        long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value")
        kinds = long.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
        mean = kinds.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("_n"), (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("_m"))
        joined = kinds.join(F.broadcast(mean.select("feature", "_m")), "feature")
        spread = joined.groupBy("feature").agg(F.sum(F.col("c") * (F.col("value") - F.col("_m")) * (F.col("value") - F.col("_m"))).alias("_ss"))
        out = mean.join(spread, "feature").select("feature", "n_distinct", F.when(F.col("_n") > 1, F.sqrt(F.col("_ss") / F.nullif(F.col("_n") - 1, F.lit(0)))).alias("std"))
    return out.withColumn("monitorable", (F.col("n_distinct") >= min_distinct) & F.coalesce(F.col("std") > min_std, F.lit(False)))


def composite_score(summary: DataFrame) -> DataFrame:
    """0.7 * selection frequency + 0.3 * min-max mean reciprocal rank."""
    lo, hi = (f("mean_reciprocal_rank").over(Window.partitionBy()) for f in (F.min, F.max))
    scaled = (F.col("mean_reciprocal_rank") - lo) / F.greatest(hi - lo, F.lit(1e-12))
    return summary.withColumn("score", 0.7 * F.col("selection_frequency") + 0.3 * scaled)


def spearman_matrix(df: DataFrame, cols: Sequence[str], key: str | None = None) -> DataFrame:
    """(feature_a, feature_b, rho): absolute rank correlation, undefined as 0; see ``rank_products``."""
    m = rank_products(df, cols, key)
    spread = np.sqrt(np.diag(m)) if len(cols) else np.zeros(0)
    rows = [(a, b, abs(float(m[i, j] / (spread[i] * spread[j]))) if spread[i] * spread[j] > 0 else 0.0) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, rho double")


def feature_family(name: str) -> str:
    """Numbered siblings share a family."""
    return re.sub(r"\d+$", "", name)


def redundancy_prune(candidates: Sequence[str], rho: DataFrame, top_k: int = 10, limit: float = 0.90,
                     max_per_family: int = 2) -> tuple[list[str], list[dict]]:
    """Greedy walk down the scored candidates (schema-sized): twins and surplus siblings are rejected.

    When too few survive, the set is filled by score, first within the family cap and then without it. Candidates
    outside the correlation table have no twin.
    """
    strong = {(r["feature_a"], r["feature_b"]): r["rho"] for r in rho.collect()}
    chosen, rejected, families = [], [], {}
    for name in candidates:
        if len(chosen) >= top_k:
            break
        pairs = [(strong[name, peer], peer) for peer in chosen if (name, peer) in strong]
        worst = max(pairs, key=lambda p: p[0], default=(0.0, None))
        family = feature_family(name)
        if worst[1] is not None and worst[0] >= limit:
            rejected.append({"feature": name, "reason": "redundant", "with": worst[1], "rho": worst[0]})
        elif families.get(family, 0) >= max_per_family:
            rejected.append({"feature": name, "reason": "family_cap", "with": family, "rho": None})
        else:
            chosen.append(name)
            families[family] = families.get(family, 0) + 1
    for capped in (True, False):
        for name in candidates:
            family = feature_family(name)
            if len(chosen) < top_k and name not in chosen and (not capped or families.get(family, 0) < max_per_family):
                chosen.append(name)
                families[family] = families.get(family, 0) + 1
    return chosen, rejected


def attribution_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))


def selection_report(diagnostics: DataFrame, rho: DataFrame, chosen: Sequence[str], rejected: Sequence[dict], stability: DataFrame) -> DataFrame:
    """One row: counts, stability and the strongest correlation left in the set."""
    inside = rho.filter(F.col("feature_a").isin(*chosen) & F.col("feature_b").isin(*chosen) & (F.col("feature_a") != F.col("feature_b")))
    top = inside.agg(F.coalesce(F.max("rho"), F.lit(0.0)).alias("max_pairwise_rho"))
    gone = diagnostics.agg(F.count_if(~F.col("monitorable")).alias("n_unmonitorable"))
    return attach_row(attach_row(top, gone), stability).select("stability", "max_pairwise_rho", "n_unmonitorable", F.lit(len(chosen)).alias("n_selected"), F.lit(len(rejected)).alias("n_rejected"))


def select_features(df: DataFrame, cols: Sequence[str], key: str, fit: Callable[[DataFrame, str, int], Sequence[float]], top_k: int = 10,
                    n_bags: int = 5, top_m: int = 25, limit: float = 0.90, max_per_family: int = 2, min_distinct: int = 10,
                    attributions: DataFrame | None = None, seed: int = 42) -> tuple[list[str], DataFrame, DataFrame]:
    """(chosen features, diagnostics per feature, report row).

    The correlation pool is the top max(6k, 60) candidates, as the rule says; candidates below are still judged by
    the family cap.
    """
    ranked = rank_gains(bagged_importance(df, cols, key, fit, n_bags, seed), top_m)
    scored = composite_score(importance_summary(ranked))
    diagnostics = scored.join(monitorability(df, cols, min_distinct), "feature", "left").fillna(False, ["monitorable"])
    if attributions is not None:
        diagnostics = diagnostics.join(attribution_importance(attributions), "feature", "left")
    usable = diagnostics.filter("monitorable").orderBy(F.desc("score"), "feature").select("feature")
    candidates = [r[0] for r in usable.collect()]
    pool = candidates[:max(6 * top_k, 60)]
    rho = spearman_matrix(df, pool) if pool else df.sparkSession.createDataFrame([], "feature_a string, feature_b string, rho double")
    chosen, rejected = redundancy_prune(candidates, rho, top_k, limit, max_per_family)
    marked = diagnostics.withColumn("selected", F.col("feature").isin(*chosen) if chosen else F.lit(False))
    return chosen, marked, selection_report(diagnostics, rho, chosen, rejected, nogueira_stability(ranked))
