"""Policies never serve the week they trained on; action logs follow the adaptation rules."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lattice as A, policies as V, reports as R


@pytest.fixture(scope="module")
def cells(spark):
    """Fourteen weeks, regimes change at 5 and 10; a partial update helps inside its regime only."""
    regime = lambda w: 0 if w < 5 else 1 if w < 10 else 2
    rows = []
    for f in range(15):
        for p in [None, *range(f + 1, 15)]:
            for a in A.ALPHAS:
                for w in range(1, 15):
                    if w > f and (p is None or w > p):
                        cur = .90 - .04 * (regime(w) - regime(f))
                        if p is not None:
                            cur += .010 if regime(p) == regime(w) else -.005
                        base = .90 - .04 * regime(w)
                        auc = a * cur + (1 - a) * base
                        rows.append((f, p, float(a), w, auc, auc - .4))
    return spark.createDataFrame(rows, "full_week long, partial_week long, alpha double, week long, auc double, f1 double").cache()


def log(spark, actions, name="p"):
    return spark.createDataFrame([(name, w, a) for w, a in enumerate(actions, 1)], "policy string, week long, action string")


def test_replay_rules(spark):
    out = A.replay_actions(log(spark, ["hedge", "partial", "hedge", "full", "none", "hedge", "hedge", "hedge", "hedge", "hedge"])).orderBy("week").collect()
    assert [r["alpha"] for r in out] == [.75, .75, .5, 1.0, 1.0, .75, .5, .25, 0.0, 0.0]
    assert [r["full_week"] for r in out] == [0, 0, 0, 4, 4, 4, 4, 4, 4, 4]
    assert [r["partial_week"] for r in out] == [None, 2, 2, None, None, None, None, None, None, None]


def test_no_action_is_graded_on_its_own_week(spark, cells):
    out = A.score_actions(log(spark, ["full"] * 14), cells).collect()
    assert len(out) == 13 and all(r["week"] > r["full_week"] for r in out) and all(r["week"] == r["acted_week"] + 1 for r in out)


def test_needless_retrain_costs(spark, cells):
    out = A.score_actions(log(spark, ["full", "none"]), cells).first()
    assert out["reward"] < 0 and out["reward"] == pytest.approx(-0.4)


def test_timely_retrain_beats_never(spark, cells):
    smart = ["full" if w in (5, 10) else "none" for w in range(1, 15)]
    both = log(spark, smart, "smart").unionByName(log(spark, ["none"] * 14, "never"))
    got = {r["policy"]: r for r in A.summarise_rewards(A.score_actions(both, cells)).collect()}
    assert got["smart"]["mean_auc"] > got["never"]["mean_auc"] and got["smart"]["full_retrains"] == 2 and got["never"]["total_reward"] == pytest.approx(0)
    control = A.random_action_control(A.summarise_rewards(A.score_actions(both, cells)), cells, cells.select("week").distinct(), 40).collect()
    assert [r["policy"] for r in control] == ["smart"] and control[0]["random_control_pct"] >= 0.9


def test_forgetting(spark, cells):
    out = A.forgetting_cost(cells)
    assert out.filter("cost <= 0").count() == 0 and out.filter("partial_week IS NOT NULL").count() > 0


def test_no_leakage_in_matrix(spark):
    rows = [(v, w, i % 2, 0.1 * (i % 7), 0.5) for v in (0, 2) for w in (1, 2, 3) for i in range(20)]
    m = V.performance_matrix(spark.createDataFrame(rows, "version long, week long, label int, score double, threshold double"))
    assert {(r["version"], r["week"]) for r in m.collect()} == {(0, 1), (0, 2), (0, 3), (2, 3)}


def test_policy_serves_later_weeks(spark):
    weeks = spark.range(1, 5).withColumnRenamed("id", "week")
    marks = spark.createDataFrame([("p", 2), ("p", 2), ("p", 3)], "policy string, week long")
    out = V.policy_from_retrains(marks, weeks.withColumn("policy", F.lit("p"))).orderBy("week").collect()
    assert [r["version"] for r in out] == [0, 0, 2, 3]
    ref = {(r["policy"], r["week"]): r["version"] for r in V.reference_policies(weeks).collect()}
    assert ref["always_retrain", 1] == 0 and ref["always_retrain", 4] == 3 and ref["never_retrain", 4] == 0


def test_zero_retrains_have_no_control(spark):
    weeks = spark.range(1, 4).withColumnRenamed("id", "week")
    m = spark.createDataFrame([(0, w, 0.7 + w / 100, 0.5) for w in (1, 2, 3)] + [(1, 2, .8, .5), (1, 3, .8, .5), (2, 3, .9, .5)], "version long, week long, auc double, f1 double")
    ev = V.evaluate_policies(V.reference_policies(weeks), m)
    got = {r["policy"]: r for r in V.random_control(ev, m, weeks, 20).collect()}
    assert got["never_retrain"]["beats_random_control"] is None and got["always_retrain"]["n_samples"] == 20


def test_jaccard_and_cosine(spark):
    flags = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 2, True), ("b", 1, False), ("c", 1, False), ("d", 1, False)], "method string, week int, confirmed_flag boolean")
    got = {(r["method_a"], r["method_b"]): r["jaccard"] for r in V.agreement_jaccard(flags).collect()}
    assert got["a", "b"] == 0.5 and got["c", "c"] == 1.0 and got["c", "d"] is None and got["a", "c"] == 0.0
    named = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "method string, feature string")
    cos = {(r["method_a"], r["method_b"]): r["cosine"] for r in R.feature_agreement_cosine(named, flags).collect()}
    assert cos["a", "b"] == pytest.approx(0.7071, abs=1e-4) and cos["c", "a"] == 0.0


def test_prettify_prefers_longer_names(spark):
    display = R.feature_display_map(spark.createDataFrame([("D1", 1), ("D15", 2), ("Feature", 3)], "feature string, rank int"))
    df = spark.createDataFrame([("D15 and D1 moved, Feature too",)], "reason string")
    assert R.prettify(df, "reason", display).first()["reason"] == "Feature 2 and Feature 1 moved, Feature 3 too"


def test_train_once_per_week(spark):
    calls = []

    def train(week):
        calls.append(week)
        return spark.createDataFrame([(week, "p")], "trained_through_week long, path string")

    wanted = spark.createDataFrame([(2,), (2,), (1,), (0,)], "week long")
    out = V.get_or_train(wanted, train(0), train)
    assert calls == [0, 1, 2] and out.count() == 3
