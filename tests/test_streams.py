"""Window forms against a sequential re-derivation, row by row."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import performance as P, streams as S
from tidemark.streaming.monitors import DEFAULTS, START, advance


def errors(spark, *rates, n=1500, seed=5):
    rng = np.random.default_rng(seed)
    x = np.concatenate([(rng.random(n) < r).astype(int) for r in rates])
    pdf = pd.DataFrame({"m": "a", "week": np.repeat(np.arange(len(rates)), n), "seq": np.arange(len(x)), "err": x})
    return spark.createDataFrame(pdf, "m string, week long, seq long, err int"), x


def sequential(x):
    """Plain one-by-one updates of the three rules."""
    ddm, eddm, hddm = [], [], []
    total, best, k, m2, mean, last, top, ref = 0.0, None, 0, 0.0, 0.0, None, 0.0, None
    bound = lambda n, c: math.sqrt(math.log(2 / c) / (2 * n))
    for i, e in enumerate(x, 1):
        total += e
        p = total / i
        s = math.sqrt(max(0.0, p * (1 - p)) / i)
        if i >= 30:
            best = (p + s, p, s) if best is None or p + s < best[0] else best
            ddm.append(p + s > best[1] + 3 * best[2])
        else:
            ddm.append(False)
        if ref is None or p + bound(i, .001) <= ref[1] + bound(ref[0], .001):
            ref = (i, p)
        hddm.append(p - ref[1] > bound(ref[0], .001) + bound(i, .001))
        if e == 1:
            if last is not None:
                gap = i - last
                k += 1
                d = gap - mean
                mean += d / k
                m2 += d * (gap - mean)
                metric = mean + 2 * math.sqrt(m2 / k)
                top = max(top, metric)
                eddm.append(k >= 10 and metric < 0.9 * top)
            last = i
    return ddm, eddm, hddm


@pytest.mark.parametrize("chunks", [1, 5])
def test_trackers_equal_sequential(spark, chunks):
    df, x = errors(spark, 0.05, 0.05, 0.35)
    ddm, eddm, hddm = sequential(x)
    flags = lambda f: [r["drift"] for r in f(df, ["m"], chunks=chunks).orderBy("seq").collect()]
    assert flags(S.ddm_rows) == ddm
    assert flags(S.hddm_rows) == hddm
    got = flags(S.eddm_rows)
    assert len(got) == len(eddm) and sum(a != b for a, b in zip(got, eddm)) == 0


def test_streaming_step_equals_sequential():
    rng = np.random.default_rng(5)
    x = np.concatenate([(rng.random(1500) < r).astype(float) for r in (0.05, 0.05, 0.35)])
    state, got = START, {"ddm": 0, "eddm": 0, "hddm": 0}
    for part in np.array_split(x, 13):
        state, found = advance(state, part, DEFAULTS)
        for name, _, drift, *_ in found:
            got[name] += int(drift.sum())
    assert [got[n] for n in ("ddm", "eddm", "hddm")] == [sum(f) for f in sequential(x)]


def test_quiet_and_signal(spark):
    quiet, _ = errors(spark, 0.05, 0.05)
    loud, _ = errors(spark, 0.05, 0.35)
    for f in (S.ddm, S.hddm):
        assert f(loud, ["m"]).filter("week = 1").first()["drift_detected"]
    assert not S.hddm(quiet, ["m"]).filter("week = 1").first()["drift_detected"]
    assert S.eddm(loud, ["m"], beta_drift=.75, beta_warning=.85, min_errors=30).filter("week = 1").first()["drift_detected"]


def scored(spark, kind, n=6000, seed=2):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.035).astype(int)
    good = np.where(y == 1, rng.uniform(.6, .99, n), rng.uniform(0, .4, n))
    s = {"good": good, "collapsed": rng.uniform(0, .4, n), "degraded": np.where(y == 1, rng.uniform(.2, .7, n), rng.uniform(.1, .6, n))}[kind]
    return pd.DataFrame({"seq": np.arange(n), "label": y, "score": s})


def test_balanced_stream_sees_recall_collapse(spark):
    mean = lambda kind, mode: S.error_stream(spark.createDataFrame(scored(spark, kind)), "label", "score", mode).agg({"err": "avg"}).first()[0]
    plain = mean("collapsed", "zero_one") - mean("good", "zero_one")
    even = mean("collapsed", "balanced") - mean("good", "balanced")
    assert plain < 0.05 and even > 0.4 and even > 5 * plain
    out = S.error_stream(spark.createDataFrame(scored(spark, "good")), "label", "score", "balanced")
    assert out.count() == 2 * int(scored(spark, "good")["label"].sum())
    brier = S.error_stream(spark.createDataFrame(scored(spark, "good")), "label", "score", "brier").agg({"err": "max"}).first()[0]
    assert 0 <= brier <= 1
    with pytest.raises(ValueError):
        S.error_stream(out, "label", "score", "other")


def test_one_class_keeps_all(spark):
    df = spark.createDataFrame([(i, 0, 0.1) for i in range(20)], "seq long, label int, score double")
    assert S.error_stream(df, "label", "score", "balanced").count() == 20


@pytest.mark.parametrize("chunks", [1, 7])
def test_auc_counts_pairs(spark, chunks):
    pdf = scored(spark, "degraded", 1200)
    pdf["score"] = pdf["score"].round(2)
    pos, neg = pdf[pdf.label == 1].score.to_numpy(), pdf[pdf.label == 0].score.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert P.auc(spark.createDataFrame(pdf), [], chunks=chunks).first()["auc"] == pytest.approx(want, abs=1e-12)
    assert P.auc(spark.createDataFrame(pdf[pdf.label == 0]), []).first()["auc"] == 0.5


@pytest.mark.parametrize("chunks", [1, 7])
def test_auc_of_every_place(spark, chunks, monkeypatch):
    """Ties, repeated scores, nulls, a short array, a row without a label and a group with one class, each place like ``auc`` alone."""
    monkeypatch.setattr(P, "PIECE_SCORES", 500)
    pdf = scored(spark, "degraded", 1200)
    rows = [(i % 3 or None, None if i == 7 else int(r.label) if i % 3 else 0, [None if i % 11 == 0 else float(r.score), round(float(r.score), 1), 0.25][:2 if i % 5 == 0 else 3])
            for i, r in enumerate(pdf.itertuples())]
    df = spark.createDataFrame(rows, "week int, label int, scores array<double>")
    got = {(r["week"], r["which"]): r[2:] for r in P.auc_each(df, ["week"], chunks=chunks).collect()}
    want = {(r["week"], j): r[1:] for j in range(3) for r in P.auc(df.selectExpr("week", "label", f"get(scores, {j}) AS score"), ["week"]).collect()}
    assert len(got) == 9 and got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], abs=1e-12) for k in want)
    f1 = {(r["week"], r["which"]): r["f1"] for r in P.f1_each(df, ["week"], "label", "scores", 3, 0.3).collect()}
    assert f1 == {(r["week"], j): r["f1"] for j in range(3) for r in P.f1_at(df.selectExpr("week", "label", f"get(scores, {j}) AS score"), ["week"], threshold=0.3).collect()}


def test_bootstrap_error(spark):
    pdf = scored(spark, "degraded", 2500)
    one = P.bootstrap_auc_se(spark.createDataFrame(pdf), [], "seq", n_boot=80, chunks=1).first()["auc_se"]
    many = P.bootstrap_auc_se(spark.createDataFrame(pdf).repartition(5), [], "seq", n_boot=80, chunks=6).first()["auc_se"]
    assert one == pytest.approx(many, abs=1e-12)
    pos, neg = pdf[pdf.label == 1].score.to_numpy(), pdf[pdf.label == 0].score.to_numpy()
    v10 = (pos[:, None] > neg).mean(axis=1)
    v01 = (pos[:, None] > neg).mean(axis=0)
    analytic = math.sqrt(v10.var(ddof=1) / len(pos) + v01.var(ddof=1) / len(neg))
    assert 0.7 * analytic < one < 1.3 * analytic
    assert P.bootstrap_auc_se(spark.createDataFrame(pdf.head(40)), [], "seq", n_boot=5).first()["auc_se"] == 0.0


def test_bootstrap_error_with_a_heavy_score(spark):
    pdf = scored(spark, "degraded", 2000)
    pdf.loc[pdf.seq % 3 == 0, "score"] = 0.3
    se = [P.bootstrap_auc_se(spark.createDataFrame(pdf), [], "seq", n_boot=25, chunks=k).first()["auc_se"] for k in (1, 8)]
    assert se[0] == pytest.approx(se[1], abs=1e-12) and se[0] > 0


def test_prequential(spark):
    good, bad = scored(spark, "good"), scored(spark, "degraded")
    rows = lambda k: spark.createDataFrame(pd.concat([good.assign(week=0), k.assign(week=1, seq=k.seq + 10**6)]))
    assert not P.prequential_auc(rows(scored(spark, "good", seed=9)), "seq", n_boot=30).first()["drift_detected"]
    fired = P.prequential_auc(rows(bad), "seq", n_boot=30).first()
    assert fired["drift_detected"] and fired["auc_drop"] > 0.02


def test_challenger(spark):
    good, bad = scored(spark, "good"), scored(spark, "degraded")
    df = spark.createDataFrame(good.assign(week=1, champion=bad.score, challenger=good.score))
    out = P.champion_challenger(df, "seq", n_boot=30).first()
    assert out["drift_detected"] and out["auc_gap"] > 0.03 and out["auc_gap_se"] > 0
    same = P.champion_challenger(df.withColumn("challenger", df.champion), "seq", n_boot=10).first()
    assert not same["drift_detected"] and same["auc_gap_se"] == 0.0


def test_threshold_one_class(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7)], "label int, score double")
    assert P.tune_threshold(df, []).first()["threshold"] == 0.5


def test_confirmation(spark):
    rows = [("m", w, f) for w, f in enumerate([True, False, True, True, False], 1)]
    df = spark.createDataFrame(rows, "method string, week int, raw_flag boolean")
    flags = lambda d: [r["confirmed_flag"] for r in d.orderBy("week").collect()]
    assert flags(S.confirm(df)) == [False, False, False, True, False]
    more = spark.createDataFrame([("m", w, True) for w in range(1, 6)], "method string, week int, raw_flag boolean")
    assert flags(S.confirm(more, reset=True)) == [False, True, False, True, False]
    with pytest.raises(ValueError):
        S.confirm(df, 3, 2)
