"""Rank products and correlations against pandas, with ties that reach over tasks."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks, selection
from tidemark.plans.checkpoints import stable


def table(n, seed):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=n)
    return pd.DataFrame({"id": np.arange(n), "x": x, "y": np.round(x + rnd.normal(size=n), 1), "hot": np.where(rnd.random(n) < .6, 0.0, x), "two": rnd.integers(0, 2, n).astype(float), "flat": 3.0, "same": -x})


@pytest.mark.parametrize("n, parts", [(1, 3), (2, 3), (50, 7), (3000, 9), (3000, 1)])
def test_like_pandas(spark, n, parts):
    pdf = table(n, n)
    cols = [c for c in pdf.columns if c != "id"]
    df = spark.createDataFrame(pdf).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.rank_products(df, cols, "id")
        numbered = ranks.rank_products(df, cols)
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    r = (pdf[cols].rank().to_numpy() - (n + 1) / 2) / n
    assert np.allclose(got, r.T @ r, atol=1e-9) and np.allclose(numbered, got, atol=1e-9)


def test_small_batches_carry_ties(spark):
    pdf = table(500, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ranks.rank_products(spark.createDataFrame(pdf), ["hot", "two", "y"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    r = (pdf[["hot", "two", "y"]].rank().to_numpy() - 250.5) / 500
    assert np.allclose(got, r.T @ r)


def test_spearman_matrix(spark):
    pdf = table(800, 5)
    pdf.loc[::9, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None)))
    cols = ["x", "y", "hot", "two", "flat", "same"]
    got = {(r["feature_a"], r["feature_b"]): r["rho"] for r in selection.spearman_matrix(df, cols, "id").collect()}
    want = pdf[cols].fillna(0.0).corr("spearman").abs().fillna(0.0)
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-9 for a in cols for b in cols) and got["x", "same"] == pytest.approx(1)


def test_nothing_to_rank(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert {r["rho"] for r in selection.spearman_matrix(empty, ["a", "b"]).collect()} == {0.0}


def test_ties_over_three_tasks():
    s = [ranks.Stretch(0, 3, 1.0, 1, 5.0, 2), ranks.Stretch(1, 4, 5.0, 4, 5.0, 4), ranks.Stretch(4, 2, 5.0, 1, 6.0, 1)]
    assert ranks.place(s) == {0: (0.0, 1.0, 5.0), 1: (3.0, 5.0, 0.0), 4: (7.0, 5.0, 9.0)}


def test_a_long_tie_is_handed_on_as_it_comes(spark, monkeypatch):
    monkeypatch.setattr(ranks.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    value = np.r_[np.zeros(300_000), 1.0, np.full(70_000, 2.0)]
    cells = pa.table({"row": np.arange(len(value)), "col": np.zeros(len(value), np.int32), "value": value}).to_batches(max_chunksize=1000)
    got = list(ranks._local_ranks(iter(cells)))
    assert sum(b.num_rows for b in got) == len(value) and max(b.num_rows for b in got) <= ranks.HELD + 1000


def test_long_ties_like_pandas(spark):
    rnd, n = np.random.default_rng(8), 400_000
    pdf = pd.DataFrame({"hot": np.where(rnd.random(n) < .6, 0.0, rnd.normal(size=n)), "two": rnd.integers(0, 2, n).astype(float), "flat": 1.0})
    got = ranks.rank_products(stable(spark.createDataFrame(pdf)), list(pdf.columns))
    r = (pdf.rank().to_numpy() - (n + 1) / 2) / n
    assert np.allclose(got, r.T @ r)
