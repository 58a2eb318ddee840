"""A small replay end to end: the decision rules hold in its tables."""

from pyspark.sql import functions as F

from tests.test_encoders import transactions
from tidemark.operators.encoders import FrozenEncoder
from tidemark.plans.replay import ReplayConfig, weekly_replay


def test_replay(spark, tmp_path):
    pdf = transactions(1500).drop(columns=[f"V{i}" for i in range(1, 7)])
    pdf["TransactionAmt"] = pdf["TransactionAmt"] * (1 + 3 * (pdf["TransactionDT"] > 90 * 86400))
    pdf["dist2"] = pdf["dist2"] + 2000 * (pdf["TransactionDT"] > 90 * 86400)
    floats = [c for c in pdf.columns if pdf[c].dtype.kind == "f"]
    raw = spark.createDataFrame(pdf.astype({c: object for c in floats}).where(pdf.notna(), None),
                                ", ".join(f"{c} {'double' if c in floats else 'string' if pdf[c].dtype == object else 'long'}" for c in pdf.columns))
    methods = ("ks_stats", "kl_divergence", "adwin", "hddm", "autoencoder")
    cfg = ReplayConfig(str(tmp_path / "run"), ref_days=90, window_days=10, methods=methods, top_k=4, n_bags=2, max_iter=3, n_boot=10, n_random=20)
    run = weekly_replay(raw, FrozenEncoder(), cfg)
    weeks = run.flags.select("week").distinct().count()
    assert len(run.monitored) == 4 and run.flags.count() == weeks * len(methods)
    # A method watches a version trained before the week it is judged on.
    assert run.flags.filter("model_version >= week").count() == 0
    assert run.performance.filter("week <= version").count() == 0
    confirmed = {(r["method"], r["week"]) for r in run.flags.filter("confirmed_flag").collect()}
    assert confirmed == {(r["method"], r["week"]) for r in run.triggers.collect()}
    assert run.triggers.groupBy("week").agg(F.sum(F.col("newly_trained").cast("int")).alias("n"), F.count("*").alias("c")).filter("n NOT IN (0, c)").count() == 0
    got = {r["policy"]: r for r in run.policies.collect()}
    assert set(got) == {*methods, "never_retrain", "always_retrain"} and got["never_retrain"]["n_retrains"] == 0
    moved = run.flags.filter("method = 'ks_stats' AND model_version = 0").collect()
    assert all("TransactionAmt" in r["names"] or "dist2" in r["names"] for r in moved)
