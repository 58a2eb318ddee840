import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import lattice as A, models as M, selection as Q, structure as T
from tidemark.operators.performance import auc
from tidemark.operators.sampling import bootstrap_bags

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 0.4, 1500) > 0.8).astype(int)
    pdf = pd.DataFrame(x, columns=COLS).assign(label=y, id=np.arange(1500), t=np.arange(1500))
    return spark.createDataFrame(pdf).cache()


@pytest.fixture(scope="module")
def trees(rows):
    return M.train_classifier(rows, COLS, "label", "t", "id", max_iter=6, max_depth=3)


def test_classifier(spark, rows, trees, tmp_path):
    scored = trees.score(rows)
    assert auc(scored, []).first()["auc"] > 0.85 and 0.05 <= trees.threshold <= 0.95
    assert M.importance_table(spark, trees, 1).first()["feature"] == "a"
    M.save_version(spark, trees, str(tmp_path / "v"))
    again = M.load_version(spark, str(tmp_path / "v"))
    assert again.threshold == trees.threshold and again.score(rows).agg(F.sum("score")).first()[0] == pytest.approx(scored.agg(F.sum("score")).first()[0])
    assert M.load_version(spark, str(tmp_path / "none")) is None


def test_tree_attributions_explain_the_margin(rows, trees):
    """Attributions of a row add up to its margin less the roots' values."""
    att = T.tree_attributions(rows, trees.model, COLS, ["id"]).groupBy("id").agg(F.sum("attribution").alias("s"))
    raw = trees.model.transform(M.features(rows, COLS)).select("id", vector_to_array("rawPrediction")[1].alias("m"))
    roots = sum(w * t["value"][0] for t, w in zip(T.tree_nodes(trees.model), trees.model.treeWeights))
    assert att.join(raw, "id").select(F.max(F.abs(F.col("m") - F.col("s") - roots))).first()[0] < 1e-9


def test_mlp_and_partial_update(spark, rows, tmp_path):
    net = M.train_mlp(rows, COLS, "label", "id", (6,), max_iter=30)
    assert auc(net.score(rows), []).first()["auc"] > 0.85
    before = list(net.model.weights.toArray())
    child = M.partial_update(net, rows.filter("t >= 1200"), "label")
    assert list(net.model.weights.toArray()) == before and list(child.model.weights.toArray()) != before and child.scale is net.scale
    copy = M.partial_update(net, rows.limit(10), "label")
    assert list(copy.model.weights.toArray()) == before
    att = T.mlp_attributions(rows, net.model.getLayers(), net.model.weights.toArray(), net.scale, ["id"])
    assert Q.attribution_importance(att).orderBy(F.desc("importance")).first()["feature"] == "a"
    M.save_version(spark, net, str(tmp_path / "n"))
    assert M.load_version(spark, str(tmp_path / "n")).score(rows).count() == 1500


def test_mlp_gradient_is_numeric_gradient(spark, rows):
    """The weight layout assumed for attributions is the one the model uses."""
    net = M.train_mlp(rows, COLS, "label", "id", (4,), max_iter=10)
    one = rows.limit(1)
    base = one.first().asDict()
    att = {r["feature"]: r["attribution"] for r in T.mlp_attributions(one, net.model.getLayers(), net.model.weights.toArray(), net.scale, ["id"]).collect()}
    h = 1e-5

    def margin(col, shift):
        moved = one.withColumn(col, F.col(col) + shift)
        r = net.model.transform(M.standardised(moved, net.scale)).select(vector_to_array("rawPrediction").alias("r")).first()["r"]
        return r[1] - r[0]

    for i, c in enumerate(COLS):
        slope = (margin(c, h) - margin(c, -h)) / (2 * h)
        assert att[c] == pytest.approx(slope * (base[c] - net.scale.mean[i]), rel=1e-3, abs=1e-6)


def test_oof_scores_are_out_of_fold(rows):
    scored, _ = M.oof_scores(rows, COLS, "label", "t", "id", max_iter=3, max_depth=2)
    assert scored.count() == 1500 and scored.select("fold").distinct().count() == 2


def test_clusters_and_reconstruction(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(3000, 2))
    x = np.c_[z, z @ np.array([[1.0, 0.5], [0.3, 1.0]]) + rng.normal(0, 0.05, (3000, 2))]
    week = np.repeat([0, 0, 1, 2], 750)
    x[week == 2] = np.where(np.arange(4) < 2, x[week == 2] * 3, -x[week == 2] * 3)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("pqrs")).assign(week=week)).cache()
    cols, ref = list("pqrs"), df.filter("week = 0")
    got = {r["week"]: r for r in T.cluster_drift(T.assign_clusters(df, T.fit_clusters(ref, cols)), cols, 5).collect()}
    assert not got[1]["drift_detected"] and got[2]["drift_detected"] and len(got[2]["top_contributing_features"]) == 4
    assert sum(got[1]["curr_counts"]) == 750 and got[1]["distance_ratio"] == pytest.approx(1, abs=0.1)
    rec = {r["week"]: r for r in T.reconstruction_drift(T.reconstruct(df, T.fit_reconstruction(ref, cols)), cols).collect()}
    assert not rec[1]["drift_detected"] and rec[2]["drift_detected"] and rec[2]["mse_z_score"] > 3


def test_prune(spark):
    rho = spark.createDataFrame([("a", "b", .95), ("b", "a", .95), ("a", "C1", .1), ("C1", "a", .1), ("a", "C2", .1), ("a", "C3", .1), ("C2", "a", .1), ("C3", "a", .1),
                                 ("C1", "C2", .7), ("C2", "C1", .7), ("C3", "C1", .7), ("C3", "C2", .7)], "feature_a string, feature_b string, rho double")
    chosen, rejected = Q.redundancy_prune(["a", "b", "C1", "C2", "C3"], rho, 3)
    assert chosen == ["a", "C1", "C2"] and rejected == [{"feature": "b", "reason": "redundant", "with": "a", "rho": .95}]
    more, rejected = Q.redundancy_prune(["a", "b", "C1", "C2", "C3"], rho, 5)
    assert more == ["a", "C1", "C2", "b", "C3"] and {r["reason"] for r in rejected} == {"redundant", "family_cap"}


def test_stability_bounds(spark):
    same = spark.createDataFrame([(b, f, float(g)) for b in range(4) for f, g in (("x", 9), ("y", 5), ("z", 1))], "bag int, feature string, gain double")
    assert Q.nogueira_stability(Q.rank_gains(same, 1)).first()["stability"] == pytest.approx(1.0)
    flat = Q.rank_gains(spark.createDataFrame([(0, "x", 1.0), (0, "y", 1.0), (0, "z", 0.0)], "bag int, feature string, gain double"), 2)
    assert {r["feature"]: r["rank"] for r in flat.collect()} == {"x": 1.5, "y": 1.5, "z": 3.0}


def test_boosting_reads_stored_rows(spark, monkeypatch):
    """Weights drawn by digests are worked out once, not in every pass of the fit."""
    from pyspark.ml.classification import GBTClassifier
    plans, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or fit(self, df, *a))
    df = spark.range(400).selectExpr("id", "cast(id as string) AS rid", "double(id % 17) AS x", "int(id % 17 > 8) AS label", "double(id) AS t")
    bags = bootstrap_bags(df, 1, "rid", 42)
    model = M.train_classifier(bags, ["x"], "label", "t", "rid", max_iter=2, max_depth=2, weight="bag_0", tune=False)
    assert model.importances() == [1.0] and "md5" not in plans[0] and "parquet" in plans[0]


def test_blends_repeat_no_row(spark):
    """The baseline goes with the scores, so blends need no join, and no row is repeated for its alphas."""
    df = spark.range(900).selectExpr("id AS rid", "id % 3 AS week", "double(id % 17) AS x", "double(id % 5) AS z", "int(id % 17 + id % 5 > 10) AS label")
    scored = A.train_lattice(df, ["x", "z"], "label", "rid", hidden=(3,), max_iter=4).cache()
    blends = A.blend_scores(scored, "rid", nested=True)
    plan = blends._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and blends.count() == scored.count() == 1200
    looked_up = A.blend_scores(scored.drop("baseline"), "rid").collect()
    flat = {(r["full_week"], r["partial_week"], r["rid"], r["week"], a): s for r in blends.collect() for a, s in zip(A.ALPHAS, r["scores"])}
    assert flat == {(r["full_week"], r["partial_week"], r["rid"], r["week"], r["alpha"]): r["score"] for r in looked_up}
    cells = A.lattice_performance(blends, "threshold").collect()
    assert len(cells) == 4 * len(A.ALPHAS) and all(0 <= c["auc"] <= 1 and 0 <= c["f1"] <= 1 for c in cells)
