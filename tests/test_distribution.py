"""Every test has a quiet case and a case that must fire."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import distribution as D
from tidemark.operators.windows import assign_week


def frame(spark, ref, curr, feature="f"):
    pdf = pd.concat([pd.DataFrame({"feature": feature, "week": 0, "value": ref}), pd.DataFrame({"feature": feature, "week": 1, "value": curr})])
    return spark.createDataFrame(pdf, "feature string, week long, value double")


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(7)


def brute_ks(a, b):
    grid = np.unique(np.r_[a, b])
    return np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()


@pytest.mark.parametrize("chunks", [1, 6])
def test_ks_equals_definition_with_ties(spark, rng, chunks):
    a, b = np.round(rng.normal(0, 1, 900), 1), np.round(rng.normal(0.4, 1.3, 400), 1)
    got = D.ks_stat(frame(spark, a, b), chunks=chunks).first()
    assert got["statistic"] == pytest.approx(brute_ks(a, b), abs=1e-12) and (got["n_ref"], got["n_curr"]) == (900, 400)


def test_ks_quiet_and_signal(spark, rng):
    ref = rng.normal(0, 1, 20000)
    quiet = D.ks_test(frame(spark, ref, rng.normal(0, 1, 5000))).first()
    loud = D.ks_test(frame(spark, ref, rng.normal(0.5, 1, 5000))).first()
    assert not quiet["drift"] and quiet["statistic"] < 0.05 and quiet["d_critical"] < 0.03
    assert loud["drift"] and loud["statistic"] > 0.15


def test_ks_significant_but_small(spark):
    rng = np.random.default_rng(11)
    got = D.ks_test(frame(spark, rng.normal(0, 1, 30000), rng.normal(0.05, 1, 30000))).first()
    assert got["significant"] and not got["drift"]


def test_ks_empty_side(spark):
    got = D.ks_stat(frame(spark, [1.0, 2.0], [None, None])).first()
    assert (got["statistic"], got["p_value"], got["drift"]) == (0.0, 1.0, False)
    none = D.ks_stat(frame(spark, [None], [1.0])).first()
    assert (none["statistic"], none["p_value"]) == (0.0, 1.0)


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.9]
    df = spark.createDataFrame([(1, f"f{i}", x) for i, x in enumerate(p)], "week int, feature string, p_value double")
    got = D.benjamini_hochberg(df).orderBy("p_value").collect()
    adj = [r["p_adjusted"] for r in got]
    assert adj == sorted(adj) and all(a >= x for a, x in zip(adj, p)) and got[0]["rejected"] and not got[-1]["rejected"]
    assert adj == pytest.approx([0.005, 0.02, 0.05125, 0.05125, 0.9])
    assert D.benjamini_hochberg(df.filter("false")).count() == 0


def brute_psi(ref, cur):
    e = np.unique(np.percentile(ref, np.linspace(0, 100, 11)))
    e[0], e[-1] = -np.inf, np.inf
    r, c = np.histogram(ref, e)[0] / len(ref), np.histogram(cur, e)[0] / len(cur)
    r, c = np.where(r == 0, 1e-4, r), np.where(c == 0, 1e-4, c)
    return ((c - r) * np.log(c / r)).sum()


@pytest.mark.parametrize("shape", ["normal", "ties"])
def test_psi_equals_definition(spark, rng, shape):
    a, b = rng.normal(0, 1, 3000), rng.normal(0.3, 1, 800)
    if shape == "ties":
        a, b = np.round(a), np.round(b)
    assert D.psi(frame(spark, a, b)).first()["psi"] == pytest.approx(brute_psi(a, b), abs=1e-9)


def test_psi_null_band(spark, rng):
    ref = rng.normal(0, 1, 20000)
    quiet = D.psi_null(frame(spark, ref, rng.choice(ref, 300)), n_boot=60).first()
    loud = D.psi_null(frame(spark, ref, rng.normal(1.2, 1, 3000)), n_boot=60).first()
    assert not quiet["drift"] and quiet["psi_null_q"] > 0.01 and loud["drift"] and loud["psi"] > 0.5
    again = D.psi_null(frame(spark, ref, rng.normal(1.2, 1, 3000)), n_boot=60).first()
    assert again["psi_null_q"] == loud["psi_null_q"]


def test_psi_small_or_constant(spark):
    assert D.psi(frame(spark, range(9), range(50))).first()["psi"] == 0.0
    assert D.psi(frame(spark, [5.0] * 40, [float(i) for i in range(40)])).first()["psi"] == 0.0


def brute_js(ref, cur, bins=20):
    e = np.linspace(min(ref.min(), cur.min()), max(ref.max(), cur.max()), bins + 1)
    p, q = np.histogram(cur, e)[0] / len(cur), np.histogram(ref, e)[0] / len(ref)
    m = (p + q) / 2
    kl = lambda a: (a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum()
    return np.sqrt((kl(p) + kl(q)) / 2)


def brute_kl(ref, cur, bins=10):
    e = np.linspace(min(ref.min(), cur.min()), max(ref.max(), cur.max()), bins + 1)
    r, c = np.histogram(ref, e, density=True)[0], np.histogram(cur, e, density=True)[0]
    r, c = np.where(r <= 0, 1e-4, r), np.where(c <= 0, 1e-4, c)
    r, c = r / r.sum(), c / c.sum()
    return (c * np.log(c / r)).sum()


def test_js_and_kl_equal_definition(spark, rng):
    a, b = rng.normal(0, 1, 4000), rng.normal(0.5, 1.5, 900)
    df = frame(spark, a, b)
    assert D.js_distance(df).first()["js_distance"] == pytest.approx(brute_js(a, b), abs=1e-9)
    assert D.kl_divergence(df).first()["kl_div"] == pytest.approx(brute_kl(a, b), abs=1e-6)


def test_js_bounds(spark, rng):
    a, b = rng.normal(0, 1, 3000), rng.normal(0.5, 1, 3000)
    one, two = D.js_distance(frame(spark, a, b)).first()[2], D.js_distance(frame(spark, b, a)).first()[2]
    assert 0 <= one <= 1 and one == pytest.approx(two, abs=1e-9) and D.js_distance(frame(spark, a, a)).first()[2] == pytest.approx(0.0)
    assert 0.99 < D.js_distance(frame(spark, [0.0] * 500, [1.0] * 500)).first()["js_distance"] <= 1.0
    assert D.js_distance(frame(spark, [2.0] * 20, [2.0] * 20)).first()["js_distance"] == 0.0


def test_votes(spark):
    rows = [(1, "ks_stats", f"f{i}", i < 3) for i in range(10)] + [(1, "psi", f"f{i}", i < 5) for i in range(10)]
    got = {r["method"]: r["raw_flag"] for r in D.feature_vote(spark.createDataFrame(rows, "week int, method string, feature string, drift boolean")).collect()}
    assert got == {"ks_stats": True, "psi": False}


def test_null_experiment(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.repeat(np.arange(4000), 2), "feature": ["a", "b"] * 4000, "value": rng.normal(0, 1, 8000)})
    alarms = D.null_alarm_rates(spark.createDataFrame(pdf), "id", trials=4, n_boot=20).cache()
    assert all(r["passed"] for r in D.alarm_summary(alarms).collect())
    assert D.calibrate_consensus(alarms).first()["degenerate"]


def test_empty_window_takes_no_number(spark):
    days = [0, 5, 13, 14, 15, 30, 44]
    df = spark.createDataFrame([(d,) for d in days], "d int").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400))
    got = [r["week"] for r in assign_week(df, "ts", 14, 7).orderBy("d").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 3]
