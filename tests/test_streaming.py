"""State must survive micro-batches: streams read several files with availableNow."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import distribution as D, encoders as E, streams as S
from tidemark.sources.tables import BucketedTable, last_batch
from tidemark.streaming import monitors as W


def run(spark, df, name, mode="append", tmp=None):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def in_parts(spark, pdf, schema, path, parts):
    for i, part in enumerate(np.array_split(pdf, parts)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path / f"part{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "*"))


@pytest.fixture(autouse=True)
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_detectors_match_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.concatenate([(rng.random(900) < r).astype(int) for r in (0.05, 0.05, 0.4)])
    pdf = pd.DataFrame({"method": "m", "version": 1, "seq": np.arange(len(x)), "err": x, "week": np.arange(len(x)) // 900})
    src = in_parts(spark, pdf, "method string, version long, seq long, err int, week long", tmp_path / "in", 3)
    got = run(spark, W.stream_detectors(src), "det", tmp=tmp_path / "ck")
    batch = spark.createDataFrame(pdf)
    for name, f in (("ddm", S.ddm_rows), ("eddm", S.eddm_rows), ("hddm", S.hddm_rows)):
        want = {r["seq"] for r in f(batch, ["method", "version"]).filter("drift").collect()}
        assert {r["seq"] for r in got.filter((F.col("detector") == name) & F.col("drift")).collect()} == want and want


def test_rows_behind_the_last_batch_are_left_out(spark, tmp_path):
    """A later batch with earlier positions changes no tracker, and its late rows are counted."""
    rng = np.random.default_rng(5)
    x = np.concatenate([(rng.random(600) < r).astype(int) for r in (0.05, 0.5)])
    rows = pd.DataFrame({"method": "m", "version": 1, "seq": np.arange(len(x)), "err": x})
    late = pd.DataFrame({"method": "m", "version": 1, "seq": [3, 599, 600], "err": [1, 1, x[600]]})
    schema = "method string, version long, seq long, err int"
    for i, part in enumerate((rows[:600], pd.concat([late, rows[601:]]))):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = run(spark, W.stream_detectors(src), "late", tmp=tmp_path / "ck")
    assert [(r["seq"], r["value"], r["threshold"]) for r in got.filter("detector = 'late'").collect()] == [(3, 2.0, 599.0)]
    for name, f in (("ddm", S.ddm_rows), ("eddm", S.eddm_rows), ("hddm", S.hddm_rows)):
        want = {r["seq"] for r in f(spark.createDataFrame(rows), ["method", "version"]).filter("drift OR warning").collect()}
        assert {r["seq"] for r in got.filter(F.col("detector") == name).collect()} == want


def test_late_rows_are_counted(spark, tmp_path):
    edges = spark.createDataFrame([("f", [0.0, 1.0, 2.0])], "feature string, edges array<double>")
    times = [["2024-01-01", "2024-01-20"], ["2024-01-21"], ["2024-01-02", "2024-01-03", "2024-02-20"]]
    for i, part in enumerate(times):
        spark.createDataFrame([(pd.Timestamp(t).to_pydatetime(), "f", 0.5) for t in part], "ts timestamp, feature string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{i}"))
    src = spark.readStream.schema("ts timestamp, feature string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = W.weekly_bin_counts(src, edges).writeStream.outputMode("append").format("memory").queryName("lately").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert W.late_rows(q) >= 1 and spark.table("lately").agg(F.sum("n")).first()[0] == 3  # of the windows that are closed


def test_confirmation_state(spark, tmp_path):
    pdf = pd.DataFrame({"method": "m", "week": np.arange(1, 7), "raw_flag": [True, True, True, True, False, True]})
    src = in_parts(spark, pdf, "method string, week long, raw_flag boolean", tmp_path / "in", 3)
    got = run(spark, W.stream_confirm(src), "conf", tmp=tmp_path / "ck").orderBy("week").collect()
    assert [r["confirmed_flag"] for r in got] == [False, True, False, True, False, False]


def test_weekly_counts_match_batch_psi(spark, tmp_path):
    rng = np.random.default_rng(1)
    ref = rng.normal(0, 1, 4000)
    cur = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=2800, freq="9min"), "feature": "f", "value": rng.normal(0.6, 1, 2800)})
    long = spark.createDataFrame(pd.DataFrame({"feature": "f", "week": 0, "value": ref}))
    edges = D.reference_edges(long)
    counts = D.psi_cells(long.unionByName(long.withColumn("week", F.lit(1).cast("long")))).select("feature", "ref_counts", "n_ref")
    src = in_parts(spark, cur, "ts timestamp, feature string, value double", tmp_path / "in", 4)
    closed = run(spark, W.weekly_bin_counts(src, edges, window="7 days"), "bins", tmp=tmp_path / "ck")
    got = W.psi_from_counts(closed, counts).orderBy("start").first()
    week = cur[(cur.ts >= pd.Timestamp(got["start"])) & (cur.ts < pd.Timestamp(got["end"]))]
    want = D.psi(long.unionByName(spark.createDataFrame(week[["feature", "value"]].assign(week=1))[["feature", "week", "value"]])).first()
    assert got["n"] == len(week) and got["psi"] == pytest.approx(want["psi"], abs=1e-9) and got["psi"] > 0.2


def test_encoder_replay(spark, tmp_path):
    ref = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (3, 3, "x")], "t long, id long, c string")
    freq, codes = E.fit_frequency(ref, ["c"]), E.fit_ordinal(ref, ["c"], "t", "id")
    src = in_parts(spark, pd.DataFrame({"id": [1, 2, 3], "c": ["y", "x", "new"]}), "id long, c string", tmp_path / "in", 2)
    got = run(spark, W.stream_encode(src, freq, ["c"], codes, ["c"]), "enc", tmp=tmp_path / "ck").orderBy("id").collect()
    assert [(r["c"], round(r["_freq_ref_c"], 4)) for r in got] == [(1, 0.3333), (0, 0.6667), (-1, 0.0)]


def test_listing_upsert(spark, tmp_path):
    from tests.test_listings import BATCH, JOB, match
    table = BucketedTable(spark, str(tmp_path / "jobs"))
    table.write(spark.createDataFrame([], JOB))
    for i, rows in enumerate([[match("1", 1, "short")], [match("1", 2, "a longer text"), match("2", 3)]]):
        spark.createDataFrame(rows, BATCH).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{i}"))
    src = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = W.stream_upsert(src, table, JOB, lambda: F.lit("now"), "o", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    assert {r["id"]: (r["description"], r["title"]) for r in table.read().collect()} == {"1": ("a longer text", "t2"), "2": ("new", "t3")}
    assert last_batch(spark, str(tmp_path / "ck") + "-merged") == 1


def test_a_batch_handed_over_again_changes_nothing(spark, tmp_path, monkeypatch):
    from tests.test_listings import BATCH, JOB, match
    table, stamps = BucketedTable(spark, str(tmp_path / "jobs")), iter("ab")
    src = spark.createDataFrame([match("1", 1)], BATCH)
    applied = []

    class Writer:
        def foreachBatch(self, f):
            applied.append(f)
            return self

        def option(self, *_):
            return self
    monkeypatch.setattr(type(src), "writeStream", property(lambda _: Writer()))
    W.stream_upsert(src, table, JOB, lambda: F.lit(next(stamps)), "o", str(tmp_path / "ck"))
    for _ in range(2):
        applied[0](src, 0)
    assert [r["updated_at"] for r in table.read().collect()] == ["a"]


@pytest.mark.parametrize("piece", [16, 1000, 10 ** 6])
def test_rows_come_in_order_a_piece_at_a_time(piece):
    rng, n = np.random.default_rng(6), 40_000
    seq, err = rng.integers(0, n, n), rng.random(n)
    got = list(W.in_order((pd.DataFrame({"seq": seq[i:i + 700], "err": err[i:i + 700]}) for i in range(0, n, 700)), piece))
    order = np.argsort(seq, kind="stable")
    assert (np.concatenate([s for s, _ in got]) == seq[order]).all() and (np.concatenate([e for _, e in got]) == err[order]).all()
    assert max(len(s) for s, _ in got) <= max(2 * piece, n // (16 * piece) * 20)
    with pytest.raises(ValueError):
        list(W.in_order([pd.DataFrame({"seq": [1.0, None], "err": [0, 1]})]))
