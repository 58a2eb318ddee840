"""Distribution drift of each feature of each window against the reference.

Input is the long table (group columns, week, feature, value) with week 0 the reference, or a ``Profile`` of it, from which
every statistic can be had: all windows, features and statistics are one counting of the rows and one ordered pass, in which
a bin's count is the difference of two cumulative counts. No row is binned and the reference is never copied per window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import EPSILON, kolmogorov_p, psi_of
from tidemark.operators.gaps import largest_gaps
from tidemark.operators.sampling import bounded_sample, digest, digest_cuts
from tidemark.operators.profiles import Pair, Profile, value_vectors, week_profile
from tidemark.plans.ordered import quantiles


def profiled(data: DataFrame | Profile, by: Sequence[str], week: str, value: str, chunks: int | None, buckets: int | None = None, bins: int | None = None) -> Profile:
    """``data`` itself where it is a profile that holds the wanted bins."""
    if not isinstance(data, Profile):
        return week_profile(data, list(by), week, value, buckets, bins, chunks=chunks)
    if (buckets is not None and data.buckets != buckets) or (bins is not None and data.bins != bins):
        raise ValueError(f"the profile has {data.buckets} quantile and {data.bins} joint bins, not {buckets} and {bins}")
    return data


def ks_stat(df: DataFrame | Profile, by: Sequence[str] = ("feature",), week: str = "week", value: str = "value",
            alpha: float = 0.05, chunks: int | None = None, cols: Sequence[str] = ()) -> DataFrame:
    """Two-sample KS of every window against week 0: statistic, p, drift, n_ref, n_curr.

    A window with no reference rows, or with no value, reports (0, 1, false). Without a profile the rows are counted in bins and
    only those are ordered that may hold the gap; see ``largest_gaps``, also for ``cols``.
    """
    by, week, table = (df.by, df.week, df.table) if isinstance(df, Profile) else (by, week, largest_gaps(df, by, week, value, cols))
    out = table.withColumn("_d", F.when((F.col("n_ref") > 0) & (F.col("n_curr") > 0), F.col("d")))
    stat = F.coalesce(F.col("_d"), F.lit(0.0))
    p = F.when(F.col("_d").isNull(), 1.0).otherwise(kolmogorov_p(stat, F.col("n_ref"), F.col("n_curr")))
    return (out.select(*by, week, stat.alias("statistic"), p.alias("p_value"), "n_ref", "n_curr")
            .withColumn("drift", F.col("p_value") < alpha))


def ks_test(df: DataFrame | Profile, by: Sequence[str] = ("feature",), week: str = "week", value: str = "value",
            alpha: float = 0.05, min_effect: float = 0.10, sample: int | None = None,
            sample_key: str | None = None, seed: int = 42, chunks: int | None = None) -> DataFrame:
    """KS gated on significance and on the size of the gap.

    Every row is used by default; ``sample`` caps each (feature, window) by hash rank, so that the p-value
    keeps some power on very large windows.
    """
    data = df if sample is None else bounded_sample(df, sample, sample_key, seed, [*by, week])
    out = ks_stat(data, by, week, value, alpha, chunks).drop("drift")
    n, m = F.col("n_ref"), F.col("n_curr")
    critical = F.when((n == 0) | (m == 0), 1.0).otherwise(F.lit(1.358) * F.sqrt((n + m) / (n.cast("double") * m)))
    return (out.withColumn("d_critical", critical).withColumn("min_effect", F.lit(min_effect))
            .withColumn("significant", F.col("p_value") < alpha)
            .withColumn("practically_significant", F.col("statistic") >= min_effect)
            .withColumn("drift", F.col("significant") & F.col("practically_significant")))


def benjamini_hochberg(df: DataFrame, by: Sequence[str] = ("week",), p: str = "p_value",
                       tie: str = "feature", alpha: float = 0.05) -> DataFrame:
    """Step-up adjusted p-values within ``by`` (a group is one row per monitored feature)."""
    w = Window.partitionBy(*by).orderBy(p, tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    raw = F.col(p) * n / F.row_number().over(w)
    rest = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (df.withColumn("_raw_q", raw)
            .withColumn("p_adjusted", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("_raw_q").over(rest))))
            .withColumn("rejected", F.col("p_adjusted") < alpha).drop("_raw_q"))


def ks_votes(df: DataFrame | Profile, week: str = "week", alpha: float = 0.05, min_effect: float = 0.10,
             chunks: int | None = None) -> DataFrame:
    """KS per feature, FDR-corrected across the features of a window, then gated on effect size."""
    tested = ks_test(df, ("feature",), week, alpha=alpha, min_effect=min_effect, chunks=chunks)
    return (benjamini_hochberg(tested, (week,), alpha=alpha)
            .withColumn("drift", F.col("rejected") & F.col("practically_significant")))


def reference_edges(df: DataFrame, by: Sequence[str] = ("feature",), week: str = "week", value: str = "value",
                    buckets: int = 10, chunks: int | None = None) -> DataFrame:
    """Distinct reference quantile edges per feature (the outer two stand for minus and plus infinity)."""
    raw = quantiles(df.filter(F.col(week) == 0), by, value, [i / buckets for i in range(buckets + 1)], "edges", chunks)
    return raw.withColumn("edges", F.array_distinct("edges"))


def psi_cells(df: DataFrame | Profile, by: Sequence[str] = ("feature",), week: str = "week", value: str = "value",
              buckets: int = 10, chunks: int | None = None) -> DataFrame:
    """Reference and window bin counts side by side, one row per (feature, window)."""
    p = profiled(df, by, week, value, chunks, buckets=buckets)
    return p.table.select(*p.by, p.week, "n_ref", "n_curr", "n_edges", "ref_counts", "curr_counts")


def psi(df: DataFrame | Profile, by: Sequence[str] = ("feature",), week: str = "week", value: str = "value",
        buckets: int = 10, threshold: float = 0.2, chunks: int | None = None) -> DataFrame:
    """PSI per (feature, window); fewer than 10 rows on a side or a constant reference gives 0."""
    p = profiled(df, by, week, value, chunks, buckets=buckets)
    usable = (F.col("n_ref") >= 10) & (F.col("n_curr") >= 10) & (F.col("n_edges") >= 2)
    val = F.when(usable, psi_of(F.col("ref_counts"), F.col("curr_counts"), F.col("n_ref"), F.col("n_curr"))).otherwise(0.0)
    return p.table.select(*p.by, p.week, "n_ref", "n_curr", val.alias("psi")).withColumn("drift", F.col("psi") >= threshold)


def psi_null(df: DataFrame | Profile, by: Sequence[str] = ("feature",), week: str = "week", value: str = "value",
             buckets: int = 10, threshold: float = 0.2, n_boot: int = 100, quantile: float = 0.99,
             seed: int = 42, chunks: int | None = None) -> DataFrame:
    """PSI against its null at this window's size: drift needs the band and the null quantile.

    Resampling rows and binning them is a multinomial draw on the reference histogram, so a replicate costs
    one draw per bin whatever the table size. The draws are made inside the tasks, per (feature, window).
    The replicate edges are the reference's, as each replicate is compared with the same reference.
    """
    profile = profiled(df, by, week, value, chunks, buckets=buckets)
    by, week, cells = profile.by, profile.week, profile.table
    usable = (F.col("n_ref") >= 10) & (F.col("n_curr") >= 10) & (F.col("n_edges") >= 2)
    key = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in [*by, week]], F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    base = cells.select(*by, week, "n_ref", "n_curr",
                        F.when(usable, F.col("ref_counts")).alias("_ref"),
                        F.when(usable, psi_of(F.col("ref_counts"), F.col("curr_counts"), F.col("n_ref"), F.col("n_curr")))
                        .otherwise(0.0).alias("psi"), key.alias("_seed"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cut = np.zeros(len(pdf))
            for i, (ref, n, key_) in enumerate(zip(pdf["_ref"], pdf["n_curr"], pdf["_seed"])):
                if ref is None:
                    continue
                share = np.asarray(ref, dtype=float)
                share = share / share.sum()
                sample = np.random.default_rng(int(key_)).multinomial(int(n), share, size=n_boot) / int(n)
                safe, got = np.where(share == 0, EPSILON, share), np.where(sample == 0, EPSILON, sample)
                cut[i] = np.quantile(((got - safe) * np.log(got / safe)).sum(axis=1), quantile)
            yield pdf.drop(columns=["_ref", "_seed"]).assign(psi_null_q=cut)

    fields = ", ".join(f"`{c}` {t}" for c, t in base.dtypes if c not in ("_ref", "_seed")) + ", psi_null_q double"
    out = base.mapInPandas(draw, fields)
    return (out.withColumn("psi_ratio", F.when(F.col("n_curr") >= 10, F.col("psi") / F.greatest("psi_null_q", F.lit(1e-9))).otherwise(0.0))
            .withColumn("chi2_expected_psi", F.when(F.col("n_curr") >= 10, F.lit(buckets - 1.0) / F.col("n_curr")).otherwise(0.0))
            .withColumn("exceeds_threshold", F.col("psi") >= threshold)
            .withColumn("exceeds_null", F.col("psi") > F.col("psi_null_q"))
            .withColumn("drift", F.col("exceeds_threshold") & F.col("exceeds_null")))


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def _usable() -> Column:
    return (F.col("n_ref") >= 10) & (F.col("n_curr") >= 10) & (F.col("hi") > F.col("lo"))


def js_distance(df: DataFrame | Profile, by: Sequence[str] = ("feature",), week: str = "week", value: str = "value",
                bins: int = 20, threshold: float = 0.10, chunks: int | None = None) -> DataFrame:
    """Jensen-Shannon distance in [0, 1]; fewer than 10 rows on a side or a constant pair gives 0."""
    profile = profiled(df, by, week, value, chunks, bins=bins)
    by, week, h = profile.by, profile.week, profile.table
    p = F.transform("joint_curr", lambda c: F.try_divide(c, F.col("n_curr")))
    q = F.transform("joint_ref", lambda c: F.try_divide(c, F.col("n_ref")))
    h = h.withColumn("_p", p).withColumn("_q", q)

    def half(a: str, b: str) -> Column:
        return _total(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log2(x / (F.lit(0.5) * (x + y)))).otherwise(0.0)))

    js = F.sqrt(F.greatest(F.lit(0.0), F.lit(0.5) * half("_p", "_q") + F.lit(0.5) * half("_q", "_p")))
    return (h.select(*by, week, F.when(_usable(), js).otherwise(0.0).alias("js_distance"))
            .withColumn("drift", F.col("js_distance") >= threshold))


def kl_divergence(df: DataFrame | Profile, by: Sequence[str] = ("feature",), week: str = "week", value: str = "value",
                  bins: int = 10, threshold: float = 0.5, chunks: int | None = None) -> DataFrame:
    """KL of the window's binned density against the reference's, in nats, empty densities lifted to EPSILON."""
    profile = profiled(df, by, week, value, chunks, bins=bins)
    by, week, h = profile.by, profile.week, profile.table

    def density(col: str, n: str) -> Column:
        return F.transform(col, lambda c: F.when(c <= 0, F.lit(EPSILON)).otherwise(c / (F.col(n) * F.col("step"))))

    h = h.withColumn("_p", F.when(_usable(), density("joint_curr", "n_curr"))).withColumn("_q", F.when(_usable(), density("joint_ref", "n_ref")))
    h = h.withColumn("_sp", _total(F.col("_p"))).withColumn("_sq", _total(F.col("_q")))
    kl = _total(F.zip_with("_p", "_q", lambda x, y: (x / F.col("_sp")) * F.ln((x / F.col("_sp")) / (y / F.col("_sq")))))
    return (h.select(*by, week, F.when(_usable(), kl).otherwise(0.0).alias("kl_div"))
            .withColumn("drift", F.col("kl_div") >= threshold))


# Share of the monitored features that must drift, per voting method; fixed values of the rules.
VOTE_FRACTION = {"ks_stats": 0.3, "psi": 0.6, "kl_divergence": 0.3, "shap": 0.3}


def feature_vote(flags: DataFrame, by: Sequence[str] = ("week", "method"), flag: str = "drift") -> DataFrame:
    """Share of features drifting per (week, method) and whether it reaches the method's bar."""
    bar = F.coalesce(*[F.when(F.col("method") == m, F.lit(v)) for m, v in VOTE_FRACTION.items()], F.lit(1.0))
    out = flags.groupBy(*by).agg(F.count(F.lit(1)).alias("features_total"),
                                 F.count_if(F.col(flag)).alias("features_crossed"))
    share = F.col("features_crossed") / F.col("features_total")
    return out.withColumn("fraction", share).withColumn("raw_flag", share >= bar)


def null_alarm_rates(df: DataFrame, key: str, fraction: float = 1 / 12, seed: int = 7, trials: int = 1,
                     n_boot: int = 40, chunks: int | None = None) -> DataFrame:
    """Alarm shares when nothing changed: each trial splits the same rows at random in two.

    ``df`` is (key, feature, value) long. Returns one row per (trial, feature) with the four alarms; a feature
    constant in both parts is left out. A trial is one digest per key, cut where the small part ends; a row is counted once with its
    membership in every trial's small part, so the rows are not copied per trial.
    """
    floor = 50
    keys = df.select(key).distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    wanted = F.greatest(F.floor(F.col("_total") * F.lit(fraction)), F.lit(floor))
    cuts = {r["trial"]: r["_cut"] for r in digest_cuts(keys, [key, "trial"], seed, ["trial"], wanted).collect()}  # one row per trial
    kind = df.schema[key].dataType

    def small(t: int) -> Column:
        if cuts.get(t) is None:
            return F.lit(False)
        at = F.struct(digest([key, F.lit(t)], seed).alias("d"), F.col(key).alias("k"))
        return at <= F.struct(F.lit(cuts[t]["_digest"]).alias("d"), F.lit(cuts[t]["_key"][0]).cast(kind).alias("k"))
    marked = df.select("feature", "value", *[small(t).alias(f"_in{t}") for t in range(trials)])
    features = sorted(tuple(r) for r in df.select("feature").distinct().collect())
    vectors = value_vectors(marked, ["feature"], "value", [F.lit(True), *[F.col(f"_in{t}") for t in range(trials)]])
    one = lambda t: tuple(int(i == t + 1) for i in range(trials + 1))
    pairs = [Pair((t, 1), tuple(a - b for a, b in zip(one(-1), one(t))), one(t)) for t in range(trials)]
    whole = Profile(vectors, ["feature"], features, pairs, [("trial", "int"), ("week", "long")], 10, None, chunks)
    varies = whole.table.filter((F.col("ref_lo") < F.col("ref_hi")) | (F.col("curr_lo") < F.col("curr_hi"))).select("trial", "feature")
    by = ["trial", "feature"]
    ks = ks_test(whole).select(*by, F.col("statistic").alias("ks_statistic"), F.col("significant").alias("ks_p_only"), F.col("drift").alias("ks_with_effect"))
    fixed = psi_null(whole, n_boot=n_boot, seed=seed).select(*by, F.col("psi"), F.col("exceeds_threshold").alias("psi_fixed"), F.col("drift").alias("psi_calibrated"))
    return ks.join(fixed, by).join(varies, by, "left_semi")


def alarm_summary(alarms: DataFrame, nominal: float = 0.05) -> DataFrame:
    """One row per trial: shares, worst eight features, PASS when gated KS stays within the nominal rate."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    worst = F.slice(F.reverse(F.array_sort(F.collect_list(F.when(
        F.col("ks_with_effect"), F.struct(F.round("ks_statistic", 3).alias("d"), "feature"))))), 1, 8)
    return (alarms.groupBy("trial").agg(
        F.count(F.lit(1)).alias("n_testable"), share("ks_p_only").alias("ks_pvalue_only"),
        share("ks_with_effect").alias("ks_with_effect_size"), share("psi_fixed").alias("psi_fixed_threshold"),
        share("psi_calibrated").alias("psi_calibrated_null"), worst.alias("offenders"))
        .withColumn("passed", F.col("ks_with_effect_size") <= nominal))


RULES = {"ks": "ks_with_effect", "psi": "psi_calibrated"}


def calibrate_consensus(alarms: DataFrame, quantile: float = 0.99, rules: Sequence[str] = ("ks", "psi")) -> DataFrame:
    """Suggested consensus bar: the null quantile of the crossed share, rounded up to 0.05, at most 0.95.

    ``degenerate`` marks the case in which no feature crossed in any trial (then there is no suggestion).
    """
    per = alarms.groupBy("trial").agg(*[F.avg(F.col(RULES[r]).cast("double")).alias(r) for r in rules])
    both = per.select("trial", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in rules])).alias("s"))
    stats = both.agg(F.avg("s.x").alias("mean"), F.max("s.x").alias("max"),
                     F.percentile("s.x", F.lit(quantile)).alias("tail"), F.count_distinct("trial").alias("n_trials"))
    bar = F.least(F.lit(0.95), F.ceil(F.col("tail") * 20) / 20)
    return (stats.withColumn("degenerate", F.col("max") == 0)
            .withColumn("suggested", F.when(F.col("max") > 0, bar)))


def feature_signal_summary(per_feature: DataFrame, by: Sequence[str] = ("ref_week", "week")) -> DataFrame:
    """Fractions and means over the features of each (reference, window) pair; PSI ratio clipped at 20."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return per_feature.groupBy(*by).agg(
        share("ks_drift").alias("ks_drift_fraction"), F.avg("ks_statistic").alias("ks_mean_statistic"),
        share("psi_drift").alias("psi_drift_fraction"),
        F.avg(F.least("psi_ratio", F.lit(20.0))).alias("psi_mean_ratio"),
        F.avg("js_distance").alias("js_mean_distance"))
