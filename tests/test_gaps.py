"""Largest gaps from bin counts, bounds and few ordered rows, against all values."""

from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gaps, sampling, signals
from tidemark.operators.signals import signal_matrix
from tidemark.plans.checkpoints import shared_folder, stable


def brute(a, b):
    grid = np.unique(np.r_[a, b])
    below = lambda x: np.searchsorted(np.sort(x), grid, "right") / len(x)
    return np.abs(below(a) - below(b)).max()


def samples():
    rnd = np.random.default_rng(5)
    return {"near": [rnd.normal(size=n) for n in (4000, 3000, 2000)], "moved": [rnd.normal(m, 1, 1500) for m in (0, 0.4, 3)],
            "tied": [np.round(rnd.normal(m, 1, 2000), 1) for m in (0, 0.2, 0)], "hot": [np.where(rnd.random(3000) < s, 1.5, rnd.normal(size=3000)) for s in (.5, .6, .5)],
            "flat": [np.full(50, 2.0), np.full(60, 2.0), np.full(9, 3.0)], "wide": [rnd.standard_cauchy(2000) * 1e200 for _ in range(3)],
            "ends": [np.r_[rnd.normal(size=200), s] for s in ([np.inf, np.inf, -np.inf], [np.inf], [-np.inf] * 7)], "odd": [np.r_[rnd.normal(size=90), [np.nan] * k] for k in (3, 40, 0)], "few": [np.array([1.0]), np.array([0.0, 1.0]), np.array([2.0])]}


@pytest.mark.parametrize("first, split", [(1024, 64), (16, 3)])
def test_like_all_values(spark, monkeypatch, first, split):
    monkeypatch.setattr(gaps, "BINS", first)
    monkeypatch.setattr(gaps, "SPLIT", split)
    made = samples()
    rows = [(f, w, float(v)) for f, weeks in made.items() for w, x in enumerate(weeks) for v in x] + [("near", 3, None), ("late", 1, 1.0), ("near", None, 5.0)]
    got = {(r["feature"], r["week"]): r for r in gaps.largest_gaps(spark.createDataFrame(rows, "feature string, week long, value double"), ["feature"], "week", "value").collect()}
    for f, (ref, *later) in made.items():
        for w, x in enumerate(later, 1):
            r = got[f, w]
            assert (r["n_ref"], r["n_curr"]) == (len(ref), len(x)) and r["d"] == pytest.approx(brute(ref, x), abs=1e-15), (f, w)
    assert got["near", 3]["d"] is None and (got["near", 3]["n_ref"], got["near", 3]["n_curr"]) == (4000, 0)
    assert got["late", 1]["d"] is None and got["late", 1]["n_ref"] == 0
    assert len(got) == 2 * len(made) + 2


@pytest.mark.parametrize("edge_rows", [1 << 20, 500])
def test_columns_like_all_values(spark, monkeypatch, edge_rows):
    """Groups side by side, with edges from few of the rows, a column of nulls in a week and what is no number."""
    monkeypatch.setattr(gaps, "EDGE_ROWS", edge_rows)
    rnd, n = np.random.default_rng(6), 6000
    week = rnd.integers(0, 4, n)
    a, b = rnd.normal(0.1 * week, 1), np.round(rnd.normal(size=n), 1)
    c = np.where(week == 2, np.nan, np.where(rnd.random(n) < 0.3, 1.5, rnd.normal(size=n)))
    pdf = pd.DataFrame({"week": week, "a": a, "b": b, "c": c})
    df = spark.createDataFrame(pdf, "week long, a double, b double, c double").withColumn("c", F.nanvl("c", F.lit(None))).withColumn("a", F.when(F.col("b") == 1.0, float("nan")).otherwise(F.col("a")))
    got = {(r["feature"], r["week"]): r for r in gaps.largest_gaps(stable(df), ["feature"], "week", "value", ["a", "b", "c"]).collect()}
    held = {"a": np.where(b == 1.0, np.inf, a), "b": b, "c": c}
    for f, w in [(f, w) for f in held for w in (1, 2, 3)]:
        ref, curr = held[f][week == 0], held[f][week == w]
        if f == "c" and w == 2:
            assert got[f, w]["d"] is None and got[f, w]["n_curr"] == 0
        else:
            assert (got[f, w]["n_ref"], got[f, w]["n_curr"]) == (len(ref), len(curr)) and got[f, w]["d"] == pytest.approx(brute(ref, curr), abs=1e-15)
    assert len(got) == 9


def test_few_rows_are_ordered(spark, monkeypatch):
    seen, ordered = [], gaps._ordered

    def spy(rows, bins, open_, counts, *rest):
        seen.append(counts[open_].sum() / counts.sum())
        return ordered(rows, bins, open_, counts, *rest)
    monkeypatch.setattr(gaps, "_ordered", spy)
    n = 200_000
    df = spark.range(2 * n).select(F.lit("f").alias("feature"), (F.col("id") % 2).alias("week"), (F.randn(3) + 0.1 * (F.col("id") % 2)).alias("value"))
    gaps.largest_gaps(stable(df), ["feature"], "week", "value").collect()
    assert all(share < 0.05 for share in seen)


def test_signal_matrix_reads_attributions_side_by_side(spark, monkeypatch):
    """The same signals as from long rows, and no table with a row for each feature is written; before, every attribution was such a row."""
    rnd, n = np.random.default_rng(2), 900
    pdf = pd.DataFrame({"rid": [f"r{i}" for i in range(n)], "week": np.arange(n) % 3, "a": rnd.normal(size=n), "b": rnd.normal(size=n) + 0.3 * (np.arange(n) % 3)})
    matrix, written, store = stable(spark.createDataFrame(pdf, "rid string, week long, a double, b double")), [], signals.stable

    def spy(df):
        out = store(df)
        written.append(out.count())
        return out
    beside = lambda r: matrix.select("week", *[(F.col(c) * (r + 1)).alias(c) for c in ("a", "b")])
    long = [r.asDict() for r in signal_matrix(matrix, ["a", "b"], [0, 1], lambda r: beside(r).unpivot(["week"], ["a", "b"], "feature", "attribution"), "rid").orderBy("ref_week", "week").collect()]
    monkeypatch.setattr(signals, "stable", spy)
    wide = [r.asDict() for r in signal_matrix(matrix, ["a", "b"], [0, 1], beside, "rid").orderBy("ref_week", "week").collect()]
    assert wide == [pytest.approx(r, abs=1e-12) for r in long] and len(wide) == 3 and max(written) == n


@pytest.mark.parametrize("n", [1, 40, 299])
def test_digest_heads_cut_like_digests(spark, n):
    df = spark.range(600).select((F.col("id") % 590).cast("string").alias("rid"), (F.col("id") % 5 == 0).cast("int").alias("label")).withColumn("head", sampling.digest_head("rid", 9))
    both = [sorted(map(tuple, sampling.bounded_sample(df, n, "rid", 9, ["label"], head=h).collect())) for h in (None, "head")]
    assert both[0] == both[1] and both[0]
    even = [sorted(map(tuple, sampling.even_classes(df, "label", "rid", 9, h).collect())) for h in (None, "head")]
    assert even[0] == even[1]


def test_signal_matrix_drops_its_attributions(spark, tmp_path):
    rnd, n = np.random.default_rng(2), 600
    pdf = pd.DataFrame({"rid": [f"r{i}" for i in range(n)], "week": np.arange(n) % 3, "a": rnd.normal(size=n), "b": rnd.normal(size=n)})
    matrix = stable(spark.createDataFrame(pdf, "rid string, week long, a double, b double"))

    def attribute(r):
        return matrix.unpivot(["rid", "week"], ["a", "b"], "feature", "attribution").withColumn("attribution", F.col("attribution") * (r + 1))

    folder = Path(shared_folder(spark).removeprefix("file:"))
    old = set(folder.rglob("*.parquet"))
    assert len(signal_matrix(matrix, ["a", "b"], [0, 1], attribute, "rid").collect()) == 3
    assert not [f for f in set(folder.rglob("*.parquet")) - old if "attribution" in pq.read_schema(f).names]
