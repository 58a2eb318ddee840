"""Scans in many chunks must give the rows of a scan in one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators import distribution as D, performance as P, sampling as S
from tidemark.plans.ordered import Pass, chunk_by_pair, chunk_by_value, followed, plain, previous, quantiles, running, running_all
from tidemark.plans.sizing import chunk_count, input_bytes


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; values repeat; a group key and some values are null."""
    rng = np.random.default_rng(1)
    n = 3000
    g = np.where(rng.random(n) < 0.7, "hot", np.where(rng.random(n) < 0.5, "b", None))
    v = np.round(rng.exponential(5, n), 1)
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "x": rng.integers(0, 9, n).astype(float)})
    return spark.createDataFrame(pdf, "id long, g string, v double, x double").cache()


def same(a, b):
    left = sorted(map(tuple, a.select(sorted(a.columns)).collect()), key=repr)
    right = sorted(map(tuple, b.select(sorted(b.columns)).collect()), key=repr)
    assert left == right


@pytest.mark.parametrize("ties", [False, True])
def test_running(skewed, ties):
    aggs = {"s": ("sum", F.col("x")), "c": ("count", F.lit(1)), "lo": ("min", F.struct("x", "id") if not ties else F.col("x")), "hi": ("max", F.col("x"))}
    order = ["v"] if ties else ["v", "id"]
    out = [plain(running(chunk_by_value(skewed, "v", k), ["g"], order, aggs, ties, True).df) for k in (1, 9)]
    same(*out)


def test_running_all_matches_single_passes(skewed):
    passes = [Pass(["g"], ["v", "id"], {"a": ("sum", F.col("x"))}), Pass([], ["v", "id"], {"b": ("count", F.lit(1))}, totals=True)]
    same(*[plain(running_all(chunk_by_value(skewed, "v", k), passes).df) for k in (1, 6)])


def test_previous(skewed):
    same(*[plain(previous(chunk_by_value(skewed, "v", k), ["g"], ["v", "id"], {"p": "x"}).df) for k in (1, 11)])


@pytest.mark.parametrize("chunks", [1, 8])
def test_quantiles_match_numpy(skewed, chunks):
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["g"]: r["edges"] for r in quantiles(skewed, ["g"], "v", probs, chunks=chunks).collect()}
    pdf = skewed.toPandas()
    for g, want in pdf.groupby(pdf["g"].fillna("~")):
        np.testing.assert_allclose(got[None if g == "~" else g], np.quantile(want["v"], probs), rtol=0, atol=1e-12)


def test_hash_rank_ignores_partitioning(skewed):
    a = S.hash_rank(skewed, "id", 3, ["g"], chunks=1)
    b = S.hash_rank(skewed.repartition(7), "id", 3, ["g"], chunks=16)
    same(a, b)
    assert a.filter("g = 'hot'").agg(F.max("rank"), F.count_distinct("rank")).first()[0] == a.filter("g = 'hot'").count()


def test_bounded_sample_and_split(skewed):
    out = S.bounded_sample(skewed, 50, "id", 1, ["g"]).groupBy("g").count().collect()
    assert {r["count"] for r in out} == {50}
    parts = {r["part"]: r["count"] for r in S.null_split(skewed, 1 / 12, "id", 1).groupBy("part").count().collect()}
    assert parts["small"] == 250 and sum(parts.values()) == 3000


@pytest.mark.parametrize("boundary", [65_536, 3, 1])
def test_samples_are_the_first_ranks(skewed, monkeypatch, boundary):
    """Whatever is left to order at the end, the sample is what ranking every row gives."""
    monkeypatch.setattr(S, "BOUNDARY", boundary)
    monkeypatch.setattr(S, "HEX", 1)
    ranked = S.hash_rank(skewed, "id", 3, ["g"], chunks=1)
    for n in (0, 1, 50, 10_000):
        same(S.bounded_sample(skewed, n, "id", 3, ["g"]), ranked.filter(F.col("rank") <= n).drop("rank"))
    whole = S.hash_rank(skewed, "id", 7)
    same(S.shuffle_split(skewed, 0.9, "id", 7), whole.withColumn("split", F.when(F.col("rank") <= 2700, "train").otherwise("eval")).drop("rank"))


def test_repeated_keys_are_one_cut(spark):
    df = spark.createDataFrame([(i % 3 if i < 300 else None,) for i in range(400)], "id long")
    sizes = {r["id"]: r["count"] for r in S.bounded_sample(df, 120, "id", 1).groupBy("id").count().collect()}
    assert sum(sizes.values()) >= 120 and all(n == 100 for n in sizes.values())
    assert S.bounded_sample(df.limit(0), 5, "id", 1).count() == 0


@pytest.mark.parametrize("chunks", [1, 6])
@pytest.mark.parametrize("times", ["spread", "one", "null"])
def test_temporal_split(spark, chunks, times):
    """Against sorting; one time may hold all rows, and null times come first."""
    rng = np.random.default_rng(2)
    t = {"spread": rng.integers(0, 400, 1000).astype(float), "one": np.full(1000, 5.0), "null": np.where(rng.random(1000) < .4, np.nan, rng.integers(0, 5, 1000))}[times]
    pdf = pd.DataFrame({"id": rng.permutation(1000), "t": t, "label": rng.integers(0, 2, 1000)})
    df = spark.createDataFrame(pdf).withColumn("t", F.nanvl("t", F.lit(None)))
    got = S.temporal_split(df, "t", "id", "label", 0.73, chunks=chunks).toPandas().set_index("id")["is_valid"]
    order = pdf.assign(t=pdf["t"].fillna(-np.inf)).sort_values(["t", "id"])["id"].tolist()
    assert [i for i in order if got[i]] == order[730:]


def test_temporal_split_falls_back(spark):
    df = spark.range(1000).select(F.col("id").alias("rid"), (F.col("id") < 300).cast("int").alias("label"), F.col("id").cast("double").alias("t"))
    got = S.temporal_split(df, "t", "rid", "label")
    ranked = S.hash_rank(df, "rid", 42, ["label"])
    same(got, ranked.withColumn("is_valid", F.col("rank") > F.when(F.col("label") == 1, 240).otherwise(560)).drop("rank"))
    none = S.temporal_split(df.limit(0), "t", "rid", "label")
    assert none.columns[-1] == "is_valid" and none.count() == 0


def test_bags_have_unit_mean(skewed):
    w = S.bootstrap_bags(skewed, 2, "id", 5).agg(F.avg("bag_0"), F.var_samp("bag_0"), F.corr("bag_0", "bag_1")).first()
    assert abs(w[0] - 1) < 0.06 and abs(w[1] - 1) < 0.12 and abs(w[2]) < 0.06


def test_sizes(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    assert 0 < input_bytes(events) < 1 << 20 and chunk_count(events) == 1
    for key, value in (("spark.tidemark.chunkBytes", "5000"), ("spark.tidemark.chunks", "7")):
        spark.conf.set(key, value)
        try:
            assert chunk_count(events) == (7 if value == "7" else -(-input_bytes(events) // 5000))
        finally:
            spark.conf.unset(key)


def test_plain_window(skewed):
    w = Window.partitionBy("g").orderBy("v", "id")
    want = skewed.withColumn("s", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("p", F.lag("x").over(w))
    for k in (1, 6):
        got = running(previous(chunk_by_value(skewed, "v", k), ["g"], ["v", "id"], {"p": "x"}), ["g"], ["v", "id"], {"s": ("sum", F.col("x"))})
        same(plain(got.df), want)


def test_followed_like_a_window(skewed):
    """Lag and position in one scan, a hot time value in several chunks."""
    rows = skewed.withColumn("v", F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 50 == 1, None).otherwise(F.col("v")))
    w = Window.partitionBy("g").orderBy("v", "id")
    want = rows.withColumn("p", F.lag("x").over(w)).withColumn("q", F.lag("v").over(w)).withColumn("n", F.row_number().over(w).cast("long"))
    for k in (1, 9):
        cut = chunk_by_pair(rows, "v", "id", k)
        same(plain(followed(cut, ["g"], ["v", "id"], {"p": "x", "q": "v"}, "n").df.withColumn("n", F.col("n").cast("long"))), want)
    sizes = {r["_chunk"]: r["count"] for r in cut.df.groupBy("_chunk").count().collect()}
    assert len(sizes) == 10 and max(sizes.values()) < 3000 / 5  # the value 5 alone has more than a third
    ordered = [r["_chunk"] for r in cut.df.orderBy("v", "id").collect()]
    assert ordered == sorted(ordered)


@pytest.fixture(scope="module")
def holes(spark):
    """Null scores, values and order keys, and a window whose values are all null."""
    rng = np.random.default_rng(9)
    n = 2000
    pdf = pd.DataFrame({"id": np.arange(n), "feature": "f", "week": rng.integers(0, 4, n), "score": np.round(rng.random(n), 2), "label": rng.integers(0, 2, n)})
    df = spark.createDataFrame(pdf, "id long, feature string, week int, score double, label int")
    hole = F.when((F.col("id") % 5 == 0) | (F.col("week") == 3), None)
    return df.withColumn("value", hole.otherwise(F.col("score"))).withColumn("score", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("score"))).cache()


@pytest.mark.parametrize("chunks", [2, 6])
def test_nulls_in_every_chunk_count(holes, chunks):
    forms = {
        "ks": lambda k: D.ks_test(holes, chunks=k),
        "psi": lambda k: D.psi(holes, chunks=k),
        "auc": lambda k: P.auc(holes, ["week"], chunks=k),
        "boot": lambda k: P.bootstrap_auc(holes, ["week"], "id", n_boot=5, chunks=k).withColumn("auc", F.round("auc", 12)),
        "lag": lambda k: plain(previous(chunk_by_value(holes, "value", k), ["week"], ["value", "id"], {"p": "id"}).df),
    }
    for name, form in forms.items():
        same(form(1), form(chunks))
    empty = {r["week"]: r for r in D.ks_test(holes, chunks=chunks).collect()}[3]
    assert (empty["n_curr"], empty["d_critical"], empty["p_value"]) == (0, 1.0, 1.0) and empty["n_ref"] == holes.filter("week = 0 AND value IS NOT NULL").count()


def test_null_scores_are_left_out(holes):
    full = holes.filter("score IS NOT NULL")
    same(P.auc(holes, ["week"]), P.auc(full, ["week"]))
    same(P.tune_threshold(holes, ["week"]), P.tune_threshold(full, ["week"]))
    same(P.f1_at(holes, ["week"]), P.f1_at(full, ["week"]))


def test_poisson_table():
    assert S.POISSON_CDF[0] == pytest.approx(np.exp(-1)) and list(S.POISSON_CDF) == sorted(S.POISSON_CDF) and 1 - S.POISSON_CDF[-1] >= 2.0 ** -53
