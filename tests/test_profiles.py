"""Statistics of many pairs of samples against counting by hand, and signals of all reference weeks."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import distribution as D, profiles as P, signals as G, structure as T
from tidemark.plans.pool import run_pool


@pytest.fixture(scope="module")
def long(spark):
    """Ties, nulls, a feature with most rows at one value, a week that only one feature has, one of nulls only, a null group."""
    rnd, parts = np.random.default_rng(3), []
    for feature, draw in (("a", lambda n, w: rnd.normal(0.3 * w, 1, n)), ("b", lambda n, w: np.where(rnd.random(n) < 0.7, 0.0, rnd.integers(0, 6, n))), (None, lambda n, w: np.round(rnd.normal(size=n), 1))):
        for w in range(5):
            if not (feature == "b" and w == 4):
                x = draw(300 if w == 0 else 80 + w, w)
                x[::7] = np.nan
                parts.append(pd.DataFrame({"feature": feature, "week": w, "value": np.full(len(x), np.nan) if feature == "a" and w == 3 else x}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def rows(spark, long):
    return spark.createDataFrame(long, "feature string, week long, value double").withColumn("value", F.nanvl("value", F.lit(None))).repartition(5)


def by_hand(a, b, buckets=10, bins=20):
    """n_ref, n_curr, gap, reference and window counts in quantile and in joint bins."""
    a, b = np.sort(a[~np.isnan(a)]), np.sort(b[~np.isnan(b)])
    grid = np.r_[a, b]
    gap = np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)).max() if len(a) and len(b) else None
    edges = list(dict.fromkeys(np.quantile(a, np.arange(buckets + 1) / buckets).tolist())) if len(a) else []
    cut = lambda x, inner: np.bincount(np.searchsorted(inner, x, "right"), minlength=len(inner) + 1).tolist()
    quantile = [cut(x, edges[1:-1]) if len(edges) > 1 else [] for x in (a, b)]
    joint = [[], []]
    if len(a) and len(b):
        lo, hi = min(a[0], b[0]), max(a[-1], b[-1])
        joint = [cut(x, lo + np.arange(1, bins) * ((hi - lo) / bins)) for x in (a, b)]
    return len(a), len(b), gap, quantile, joint


@pytest.mark.parametrize("chunks", [None, 1, 7])
@pytest.mark.parametrize("refs", [None, [0, 1, 3]])
def test_profile_like_counting(rows, long, chunks, refs):
    got = P.week_profile(rows, ref_weeks=refs, chunks=chunks)
    seen = 0
    for r in got.table.collect():
        own = long[long["feature"].isna()] if r["feature"] is None else long[long["feature"] == r["feature"]]
        through = 0 if refs is None else r["ref_week"]
        n, m, gap, quantile, joint = by_hand(own[own["week"] <= through]["value"].to_numpy(), own[own["week"] == r["week"]]["value"].to_numpy())
        assert (r["n_ref"], r["n_curr"], [r["ref_counts"], r["curr_counts"]], [r["joint_ref"], r["joint_curr"]]) == (n, m, quantile, joint)
        assert r["d"] == (None if gap is None else pytest.approx(gap, abs=1e-12))
        seen += 1
    assert seen == (11 if refs is None else 11 + 8 + 2)  # b has no week 4


def test_profile_needs_no_bins(rows):
    plain = P.week_profile(rows, buckets=None, bins=None)
    assert [tuple(r) for r in D.ks_test(plain).orderBy("feature", "week").collect()] == [tuple(r) for r in D.ks_test(P.week_profile(rows)).orderBy("feature", "week").collect()]
    with pytest.raises(ValueError):
        D.psi(plain)


def test_empty_table(spark):
    none = spark.createDataFrame([], "feature string, week long, value double")
    assert D.ks_test(none).count() == 0 and D.psi_null(none).count() == 0 and D.js_distance(none).count() == 0


def test_many_trials_split_like_one(spark):
    """A trial's alarms don't depend on how many trials are counted together; each small part has the wanted size."""
    rnd = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.repeat(np.arange(1200), 2), "feature": ["x", "y"] * 1200, "value": rnd.normal(size=2400)})
    df = spark.createDataFrame(pdf)
    flat = spark.createDataFrame(pd.DataFrame({"id": np.arange(1200), "feature": "flat", "value": 1.0}))
    few, many = (D.null_alarm_rates(df.unionByName(flat), "id", trials=t).drop("psi_calibrated").toPandas().set_index(["trial", "feature"]).sort_index() for t in (2, 12))
    assert len(few) == 4 and len(many) == 24 and few.equals(many.loc[few.index])
    wanted = {t: set(pdf["id"].unique()[np.argsort([hashlib.md5(f"{i}:{t}:7".encode()).hexdigest() for i in range(1200)])[:100]]) for t in (0, 1)}
    for t, small in wanted.items():
        x = pdf[(pdf["feature"] == "x")]
        inside = x["id"].isin(small)
        assert few.loc[(t, "x"), "ks_statistic"] == pytest.approx(by_hand(x[~inside]["value"].to_numpy(), x[inside]["value"].to_numpy())[2], abs=1e-12)


@pytest.fixture(scope="module")
def wide(spark):
    rnd, n = np.random.default_rng(8), 1500
    week = rnd.integers(0, 4, n)
    x = rnd.normal(size=(n, 3)) * [1, 10, 0.1] + [1000, 0, 5] + np.outer(week == 3, [0, 30, 0])
    pdf = pd.DataFrame({"rid": np.arange(n), "week": week, "p": x[:, 0], "q": x[:, 1], "r": x[:, 2], "flat": 2.0})
    return pdf, spark.createDataFrame(pdf).repartition(4)


COLS = ["p", "q", "r", "flat"]


def test_references_add_up_over_weeks(wide):
    pdf, df = wide
    refs = G.references(G.vectors_of(df, COLS), [0, 2], [0, 1, 2, 3], 4)
    for ref in refs:
        own = df.filter(F.col("week") <= ref.week)
        scale = T.fit_scale(own, COLS)
        assert np.allclose(ref.mean, scale.mean) and np.allclose(ref.std, scale.std, rtol=1e-9)
        state = T.fit_reconstruction(own, COLS)
        assert np.allclose(ref.projector, np.array(state.components).T @ np.array(state.components), atol=1e-6)


def test_structure_signals_like_numpy(wide):
    pdf, df = wide
    rows, weeks = G.vectors_of(df, COLS), [0, 1, 2, 3]
    refs = G.references(rows, [0, 2], weeks, 4)
    G.fit_centres(rows, refs, (pdf["week"].to_numpy()[:400], pdf[COLS].to_numpy()[:400]), k=3)
    got = {(r["ref_week"], r["week"]): r for r in G.structure_signals(rows, refs, weeks, k=3).collect()}
    assert set(got) == {(0, 1), (0, 2), (0, 3), (2, 3)}
    for ref in refs:
        z, week = ref.scaled(pdf[COLS].to_numpy()), pdf["week"].to_numpy()
        near, distance = G._nearest(z, ref.centres)
        held = week <= ref.week
        again = np.stack([z[held & (near == i)].mean(axis=0) for i in range(3)])
        assert np.abs(again - ref.centres).max() < 2e-2  # settled, or nearly so after the last round
        rmse = np.sqrt(((z - z @ ref.projector) ** 2).mean(axis=1))
        for w in weeks[ref.week + 1:]:
            r = got[ref.week, w]
            assert r["cluster_distance_ratio"] == pytest.approx(distance[week == w].mean() / distance[held].mean())
            z_score = (rmse[week == w].mean() - rmse[held].mean()) / max(rmse[held].std(), 1e-6)
            assert r["autoencoder_z_score"] == pytest.approx(np.clip(z_score, -10, 10), rel=1e-6, abs=1e-6)
    assert got[0, 3]["cluster_distance_ratio"] > 1.2 > got[0, 1]["cluster_distance_ratio"]


def test_pool_keeps_order_and_raises(spark):
    assert run_pool(spark, lambda n: spark.range(n).count(), [5, 1, 3], 2) == [5, 1, 3]
    with pytest.raises(ZeroDivisionError):
        run_pool(spark, lambda n: 1 // n, [1, 0], 2)
