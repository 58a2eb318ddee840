"""The weekly replay: one frozen matrix, detectors per model version, retraining decisions, policy comparison.

Only one thing is truly sequential: which version a method watches in week w + 1 depends on its flags up to week w. So
for every version all later weeks are judged at once, as jobs over the whole matrix, into a table of one row per
(week, method). The driver then walks the weeks over those small tables and trains a version when a flag is confirmed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import models as M, policies as V, streams as S, structure as T
from tidemark.operators.distribution import feature_vote, js_distance, ks_votes, psi_null
from tidemark.operators.encoders import FrozenEncoder
from tidemark.operators.performance import auc, champion_challenger, prequential_auc
from tidemark.operators.selection import select_features
from tidemark.operators.windows import align_schema, assign_week, to_long

METHODS = ("ks_stats", "psi", "kl_divergence", "ddm", "eddm", "adwin", "hddm", "shap", "clustering", "autoencoder", "prequential_auc", "champion_vs_challenger")
VERDICT = "week long, method string, raw_flag boolean, value double, threshold double, names array<string>"


@dataclass
class ReplayConfig:
    folder: str  # shared folder for the matrix, scores and models
    ref_days: float = 90
    window_days: float = 7
    methods: Sequence[str] = METHODS
    top_k: int = 20
    n_bags: int = 5
    k: int = 2
    n: int = 2
    max_iter: int = 20
    n_boot: int = 100
    n_random: int = 200
    start: str = "2017-11-30"
    seed: int = 42


@dataclass
class Replay:
    """Result tables of a run."""

    monitored: list[str]
    flags: DataFrame
    triggers: DataFrame
    adoptions: DataFrame
    performance: DataFrame
    policies: DataFrame
    controls: DataFrame
    agreement: DataFrame
    versions: dict[int, M.Classifier] = field(default_factory=dict)


def build_matrix(raw: DataFrame, encoder: FrozenEncoder, cfg: ReplayConfig) -> tuple[DataFrame, list[str]]:
    """Encode every row once with the encoder fitted on week 0; stored by week, so a week filter prunes files."""
    c, spark = encoder.cols, raw.sparkSession
    timed = raw.withColumn("_ts", F.timestamp_seconds(F.unix_timestamp(F.lit(f"{cfg.start} 00:00:00")) + F.col(c.order)))
    weekly = assign_week(timed, "_ts", cfg.ref_days, cfg.window_days, "_week").drop("_ts")
    rows = encoder.prepare(weekly.drop("_week")).join(weekly.select(c.key, F.col("_week").alias("week")), c.key)
    c.dropped = [*c.dropped, "week"]
    encoder.fit(rows.filter("week = 0"))
    wide = encoder.transform(rows, [c.key, c.order, "week"])
    cols = list(encoder.feature_schema)
    seq = F.col(c.order) * 1_000_000 + F.pmod(F.col(c.key), F.lit(1_000_000))
    flat = align_schema(wide.withColumns({"rid": F.col(c.key), "t": F.col(c.order), "seq": seq, "label": F.col(c.label).cast("int")}), cols, ["rid", "t", "seq", "week", "label"])
    flat.write.mode("overwrite").partitionBy("week").parquet(f"{cfg.folder}/matrix")
    return spark.read.parquet(f"{cfg.folder}/matrix").withColumn("week", F.col("week").cast("long")), cols


def verdicts(matrix: DataFrame, scores: DataFrame, oof: DataFrame | None, model: M.Classifier, version: int, monitored: Sequence[str], cfg: ReplayConfig) -> DataFrame:
    """(week, method, raw_flag, value, threshold, names) of every week after ``version``, the reference being all before."""
    wanted, out = set(cfg.methods), []
    shifted = matrix.withColumn("week", F.greatest(F.lit(0), F.col("week") - version))
    scored = scores.withColumn("week", F.greatest(F.lit(0), F.col("week") - version))
    long = to_long(shifted, ["rid", "week"], monitored)

    def add(df: DataFrame, method: str, flag: str, value: str | None = None, threshold=None) -> None:
        bar = F.lit(threshold) if not isinstance(threshold, str) else F.col(threshold)
        out.append(df.select(F.col("week").cast("long").alias("week"), F.lit(method).alias("method"), F.col(flag).alias("raw_flag"),
                             (F.col(value) if value else F.lit(None)).cast("double").alias("value"), bar.cast("double").alias("threshold"), F.lit(None).cast("array<string>").alias("names")))

    votes = []
    if "ks_stats" in wanted:
        votes.append(ks_votes(long).select("week", F.lit("ks_stats").alias("method"), "feature", "drift"))
    if "psi" in wanted:
        votes.append(psi_null(long, n_boot=cfg.n_boot, seed=cfg.seed).select("week", F.lit("psi").alias("method"), "feature", "drift"))
    if "kl_divergence" in wanted:
        votes.append(js_distance(long).select("week", F.lit("kl_divergence").alias("method"), "feature", "drift"))
    if "shap" in wanted:
        attributed = T.tree_attributions(shifted, model.model, model.cols, ["rid", "week"]).filter(F.col("feature").isin(*monitored))
        votes.append(T.attribution_drift(attributed).select("week", F.lit("shap").alias("method"), "feature", "drift"))
    for v in votes:
        share = feature_vote(v)
        names = v.groupBy("week", "method").agg(F.array_sort(F.collect_list(F.when(F.col("drift"), F.col("feature")))).alias("names"))
        out.append(share.join(names, ["week", "method"]).select("week", "method", "raw_flag", F.col("fraction").alias("value"), F.lit(None).cast("double").alias("threshold"), "names"))
    later = scored.filter("week > 0")
    if wanted & {"ddm", "eddm", "hddm"}:
        stream = S.error_stream(later, "label", "score", "balanced", model.threshold, "seq", ["week"], cfg.seed).withColumn("stream", F.lit(0))
        if "ddm" in wanted:
            add(S.ddm(stream, ["stream"]), "ddm", "drift_detected", "mean_error_rate", "drift_threshold")
        if "eddm" in wanted:
            add(S.eddm(stream, ["stream"], beta_drift=0.75, beta_warning=0.85, min_errors=100), "eddm", "drift_detected", "metric_value", "drift_threshold")
        if "hddm" in wanted:
            bar = S.hddm(stream, ["stream"]).withColumn("bar", F.col("reference_mean") + F.col("hoeffding_bound"))
            add(bar, "hddm", "drift_detected", "mean_error_rate", "bar")
    if "adwin" in wanted:
        add(S.adwin(scored, [], value="score"), "adwin", "drift_detected", "z_score", "z_threshold")
    if "prequential_auc" in wanted:
        p = prequential_auc(scored, "rid", n_boot=cfg.n_boot, seed=cfg.seed).withColumn("bar", 2.0 * F.col("auc_se"))
        add(p, "prequential_auc", "drift_detected", "auc_drop", "bar")
    if "clustering" in wanted:
        state = T.fit_clusters(shifted.filter("week = 0"), monitored, seed=cfg.seed)
        add(T.cluster_drift(T.assign_clusters(shifted, state), monitored, 5), "clustering", "drift_detected", "distance_ratio", 1.5)
    if "autoencoder" in wanted:
        state = T.fit_reconstruction(shifted.filter("week = 0"), monitored)
        add(T.reconstruction_drift(T.reconstruct(shifted, state), monitored), "autoencoder", "drift_detected", "mse_z_score", 3.0)
    if "champion_vs_challenger" in wanted and oof is not None:
        held = auc(scored.filter("week = 0"), []).first()["auc"]
        pair = later.withColumnRenamed("score", "champion").join(oof, "rid")
        add(champion_challenger(pair, "rid", baseline_auc=held, n_boot=cfg.n_boot, seed=cfg.seed), "champion_vs_challenger", "drift_detected", "auc_gap", 0.03)
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.withColumn("week", F.col("week") + version)


def weekly_replay(raw: DataFrame, encoder: FrozenEncoder, cfg: ReplayConfig) -> Replay:
    """Run the replay over a transaction table (identity columns already joined)."""
    spark = raw.sparkSession
    matrix, cols = build_matrix(raw, encoder, cfg)
    weeks = sorted(r[0] for r in matrix.select("week").distinct().collect() if r[0] > 0)
    models: dict[int, M.Classifier] = {}
    judged: dict[int, dict] = {}
    fit = lambda df, weight, seed: M.train_classifier(df, cols, "label", "t", "rid", seed, cfg.max_iter, weight=weight, tune=False).importances()
    reference = matrix.filter("week = 0")
    monitored, _, _ = select_features(reference, cols, "rid", fit, cfg.top_k, cfg.n_bags, seed=cfg.seed)
    oof = None
    if "champion_vs_challenger" in cfg.methods:
        for w in weeks:  # two fits per week; each is a job over that week's files
            part, _ = M.oof_scores(matrix.filter(F.col("week") == w), cols, "label", "t", "rid", seed=cfg.seed, max_iter=cfg.max_iter)
            part.select("rid", F.col("oof_score").alias("challenger")).write.mode("overwrite").parquet(f"{cfg.folder}/challenger/w={w}")
        oof = spark.read.parquet(f"{cfg.folder}/challenger").drop("w")

    def train(v: int) -> None:
        model = M.train_classifier(matrix.filter(F.col("week") <= v), cols, "label", "t", "rid", cfg.seed, cfg.max_iter)
        M.save_version(spark, model, f"{cfg.folder}/models/w{v}")
        models[v] = model
        scored = model.score(matrix).select("rid", "seq", "week", "label", "score", F.lit(float(model.threshold)).alias("threshold"))
        scored.write.mode("overwrite").parquet(f"{cfg.folder}/scores/version={v}")
        if v < weeks[-1]:
            scores = spark.read.parquet(f"{cfg.folder}/scores/version={v}")
            table = verdicts(matrix, scores, oof, model, v, monitored, cfg)
            judged[v] = {(r["week"], r["method"]): r for r in table.collect()}  # weeks x methods rows

    train(0)
    held = dict.fromkeys(cfg.methods, 0)
    recent: dict[str, list[bool]] = {m: [] for m in cfg.methods}
    flags, triggers = [], []
    for w in weeks:
        confirmed = []
        for m in cfg.methods:
            row = judged[held[m]].get((w, m))
            raw_flag = bool(row and row["raw_flag"])
            recent[m] = [*recent[m], raw_flag][-cfg.n:]
            sure = sum(recent[m]) >= cfg.k
            flags.append((w, m, held[m], raw_flag, sure, row["value"] if row else None, row["threshold"] if row else None, list(row["names"] or []) if row else []))
            if sure:
                confirmed.append(m)
        if confirmed:
            new = w not in models
            if new:
                train(w)
            for m in confirmed:
                held[m], recent[m] = w, []
                triggers.append((m, w, w, [x for x in confirmed if x != m], new, f"fired in {cfg.k} of the last {cfg.n} windows"))
    for w in weeks[:-1]:  # the versions no method asked for, so that every policy can be read
        if w not in models:
            model = M.train_classifier(matrix.filter(F.col("week") <= w), cols, "label", "t", "rid", cfg.seed, cfg.max_iter)
            M.save_version(spark, model, f"{cfg.folder}/models/w{w}")
            models[w] = model
            model.score(matrix.filter(F.col("week") > w)).select("rid", "seq", "week", "label", "score", F.lit(float(model.threshold)).alias("threshold")).write.mode("overwrite").parquet(f"{cfg.folder}/scores/version={w}")
    scores = spark.read.parquet(f"{cfg.folder}/scores").withColumn("version", F.col("version").cast("long"))
    V.performance_matrix(scores).write.mode("overwrite").parquet(f"{cfg.folder}/performance")
    performance = spark.read.parquet(f"{cfg.folder}/performance")
    flag_table = spark.createDataFrame(flags, "week long, method string, model_version long, raw_flag boolean, confirmed_flag boolean, value double, threshold double, names array<string>")
    trigger_table = spark.createDataFrame(triggers, "method string, week long, model_version long, shared_with array<string>, newly_trained boolean, reason string")
    week_table = spark.createDataFrame([(w,) for w in weeks], "week long")
    grid = week_table.withColumn("policy", F.explode(F.array(*[F.lit(m) for m in cfg.methods]))).select("policy", "week")
    in_force = V.policy_from_retrains(trigger_table.select(F.col("method").alias("policy"), "week"), grid).unionByName(V.reference_policies(week_table))
    policies = V.evaluate_policies(in_force, performance)
    return Replay(monitored, flag_table, trigger_table, V.adopt(trigger_table), performance, policies,
                  V.random_control(policies, performance, week_table, cfg.n_random, cfg.seed), V.agreement_jaccard(flag_table), models)


def open_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The stored feature matrix of an earlier run."""
    return spark.read.parquet(f"{folder}/matrix")
