"""Queries whose reference weeks or versions come from the weeks of the data, on made tables with few weeks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.windows import assign_week, cumulative_window, recent_window, window_counts
from tidemark.workload import model_queries as Q


def dates(n, days):
    return (pd.Timestamp("1995-01-01") + pd.to_timedelta(np.linspace(0, days - 1, n).round(), unit="D")).astype("datetime64[us]")


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Line items of weeks 0 to 2; what a return depends on changes from week to week."""
    rnd, n, folder = np.random.default_rng(4), 900, str(tmp_path_factory.mktemp("lines"))
    ship = dates(n, 730 + 2 * 180)
    quantity, price = rnd.integers(1, 50, n).astype(float), rnd.uniform(100, 9000, n)
    late = np.asarray(ship >= ship[0] + pd.Timedelta(days=730))
    pd.DataFrame({"l_orderkey": np.arange(n), "l_partkey": np.arange(n) % 30, "l_suppkey": np.arange(n) % 7, "l_linenumber": np.ones(n, dtype="int32"), "l_quantity": quantity, "l_extendedprice": price,
                  "l_discount": rnd.integers(0, 10, n) / 100, "l_tax": rnd.integers(0, 8, n) / 100, "l_returnflag": np.where(np.where(late, price > 4000, quantity > 25), "R", "N"),
                  "l_linestatus": "O", "l_shipdate": ship}).to_parquet(f"{folder}/lineitem.parquet")
    return folder


def test_signal_matrix_has_all_pairs_of_weeks(spark, lines):
    rows = entry.queries()["signal_matrix"](spark, lines).collect()
    assert sorted((r["ref_week"], r["week"]) for r in rows) == [(0, 1), (0, 2), (1, 2)]
    assert all(r["attribution_mean_shift"] < 100 for r in rows)  # of scaled inputs, not of the prices themselves


def test_attributions_are_of_the_reference_weeks_model(spark, lines):
    w = Q.wide(spark, lines)
    assert Q.weeks_with_later(w) == [0, 1]
    size = [{r["feature"]: r["a"] for r in Q.fitted_attributions(w, r).groupBy("feature").agg(F.avg(F.abs("attribution")).alias("a")).collect()} for r in (0, 1)]
    assert size[0]["quantity"] > size[0]["price"] and size[0] != size[1]


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    """Orders of weeks 0 to 3."""
    rnd, n, folder = np.random.default_rng(5), 1600, str(tmp_path_factory.mktemp("orders"))
    pd.DataFrame({"o_orderkey": np.arange(n), "o_custkey": rnd.integers(0, 50, n), "o_orderstatus": "O", "o_totalprice": rnd.uniform(1000, 500000, n),
                  "o_orderdate": dates(n, 730 + 3 * 360), "o_orderpriority": [f"{p}-X" for p in rnd.integers(1, 6, n)]}).to_parquet(f"{folder}/orders.parquet")
    return folder


def test_versions_of_all_weeks_are_scored(spark, orders):
    rows = entry.queries()["score_versions"](spark, orders).collect()
    assert sorted((r["version"], r["week"]) for r in rows) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_methods_have_later_versions_in_force(spark, orders):
    ready = Q.order_rows(spark, orders)
    assert sorted((r["week"], r["version"]) for r in Q.in_force(ready).filter("method = 'adwin'").collect()) == [(1, 0), (2, 1), (3, 2)]
    counts = {r["week"]: r["count"] for r in ready.groupBy("week").count().collect()}
    got = {(r["method"], r["week"]): r["n"] for r in entry.queries()["method_scores"](spark, orders).collect()}
    assert got == {(m, w): counts[w] for m in ("psi", "adwin") for w in (1, 2, 3)}


def test_get_or_train_trains_all_weeks(spark, orders):
    rows = entry.queries()["get_or_train"](spark, orders).collect()
    assert sorted(r["trained_through_week"] for r in rows) == [0, 1, 2, 3] and all(r["n_rows"] > 0 for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_weeks_of_one_pass(spark, seed):
    """Against numbering the windows by hand, with gaps, edges of windows and times before 1970."""
    rnd = np.random.default_rng(seed)
    micros = np.unique(np.concatenate([rnd.integers(-10 ** 12, 10 ** 13, 40), rnd.integers(-10 ** 12, -10 ** 12 + 10 ** 11, 20)]))
    start, ref, width = micros.min(), 5 * 86_400 * 10 ** 6, 3 * 86_400 * 10 ** 6
    micros = np.concatenate([micros, start + ref + width * np.array([0, 4]), start + ref + width * np.array([2, 7]) - 1])
    raw = (micros - start - ref) // width
    number = {w: i + 1 for i, w in enumerate(sorted(set(raw[raw >= 0])))}
    df = spark.createDataFrame([(int(m),) for m in micros] + [(None,)], "m long").withColumn("ts", F.timestamp_micros("m"))
    got = {r["m"]: r["week"] for r in assign_week(df, "ts", 5, 3).collect()}
    assert all(got[int(m)] == (number[w] if w >= 0 else 0) for m, w in zip(micros, raw)) and got[None] is None


def test_window_sizes_like_filters(spark):
    df = spark.createDataFrame([(w,) for w in [0, 0, 1, 1, 1, 3, 4, 4, 6]], "week long")
    got = {r["upto"]: (r["n_cumulative"], r["n_recent"]) for r in window_counts(df, 2).collect()}
    assert got == {w: (cumulative_window(df, w).count(), recent_window(df, w, 2).count()) for w in (1, 3, 4, 6)}
