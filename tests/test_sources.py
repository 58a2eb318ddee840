import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.listings import import_matches
from tidemark.plans.checkpoints import shared_root
from tidemark.sources import tables as X
from tidemark.workload import model_queries as Q
from tidemark.workload.base import events


def test_pair(spark, tmp_path):
    X.write_csv(spark.createDataFrame([(1, 2.5)], "TransactionID long, amt double"), str(tmp_path / "train_transaction.csv"))
    with pytest.raises(FileNotFoundError):
        X.read_pair(spark, str(tmp_path))
    X.write_csv(spark.createDataFrame([(1, "phone")], "TransactionID long, DeviceType string"), str(tmp_path / "train_identity.csv"))
    fact, ident = X.read_pair(spark, str(tmp_path), "TransactionID long, amt double")
    assert fact.first()["amt"] == 2.5 and ident.first()["DeviceType"] == "phone" and X.read_pair(spark, str(tmp_path), split="test") is None


def test_record_fields():
    assert X._fields(X.STATUS_RECORD) == ["value", "threshold", "drifted_features", "details"] and X._fields(X.METHOD_RECORD)[-1] == "status"


def test_report_document(spark, tmp_path):
    m = spark.createDataFrame([(w, x, w > 1, False, 0) for w in (1, 2) for x in ("ks_stats", "psi")], "week int, method string, raw_flag boolean, confirmed_flag boolean, model_version long")
    X.write_report_json(m, str(tmp_path / "r"), {"top_k": 5})
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part*"))
    doc = json.loads(text)
    assert doc["top_k"] == 5 and [w["week"] for w in doc["weekly_records"]] == [1, 2]
    assert X.read_report_json(spark, str(tmp_path / "r")).filter("raw_flag").count() == 2


def test_report_has_the_whole_record(spark, small, tmp_path):
    Q.write_record(spark, small, str(tmp_path / "r"))
    rows = X.read_report_records(spark, str(tmp_path / "r")).collect()
    counts = {r["week"]: r["count"] for r in events(spark, small).groupBy("week").count().collect()}
    assert {r["week"]: r["rows"] for r in rows} == counts and [r["week"] for r in rows if r["is_baseline"]] == [0]
    told = [r for r in rows if r["confirmed_flag"]]
    assert told and all(r["reason"] and r["metrics"]["crossed"] >= 1 and r["metrics"]["monitored"] >= r["metrics"]["crossed"] and r["to_version"] == r["week"] and r["retrain_count"] >= 1 for r in told)
    assert all(r["reason"] is None and r["metrics"] is None and r["to_version"] is None for r in rows if not r["confirmed_flag"])
    for r in (r for r in rows if r["method"]):
        assert r["drifted_features"] == sorted(r["drifted_features"]) and set(r["drifted_features"]) <= set(r["details"]) == set(r["top_features"])
        assert (len(r["drifted_features"]) / len(r["details"])) == pytest.approx(r["value"]) and (r["value"] >= r["threshold"]) == r["raw_flag"] == r["confirmation_state"][-1]
    features = X.read_report_features(spark, str(tmp_path / "r")).collect()
    assert {(r["week"], r["feature"]) for r in features} == {(r["week"], f) for r in rows for f in r["top_features"]} and all(set(r["metrics"]) == set(r["flags"]) for r in features)
    assert [r["feature"] for r in sorted((r for r in features if r["week"] == 1), key=lambda r: r["rank"])] == next(r["top_features"] for r in rows if r["week"] == 1)
    flags = sorted(tuple(r) for r in entry.queries()["report_json"](spark, small).collect())
    assert flags == sorted((r["week"], r["method"], r["raw_flag"], r["confirmed_flag"], r["model_version"]) for r in rows if r["method"])


def test_matches_nested_and_flat(spark, tmp_path):
    flat = {"portal": "naukri", "job_id": "2", "title": "B", "company": "C", "url": "u2"}
    (tmp_path / "m.json").write_text(json.dumps([{"job": {**flat, "job_id": "1", "title": "A"}, "score": 80, "skill_overlap": ["x"]}, flat]))
    rows = {r["job_id"]: r for r in import_matches(X.read_matches_json(spark, str(tmp_path / "m.json"))).collect()}
    assert rows["1"]["match_score"] == 80 and rows["1"]["title"] == "A" and rows["1"]["skill_overlap"] == ["x"]
    assert rows["2"]["match_score"] == 0 and rows["2"]["gaps"] == [] and rows["2"]["recommended"] is False


def test_bucketed_table(spark, tmp_path):
    t = X.BucketedTable(spark, str(tmp_path / "t"), "a", 8)
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.read("a long").count() == 0
    t.merge(spark.range(3).toDF("a"), lambda old, new: old.unionByName(new), "a long")
    t.write(spark.range(100).toDF("a"), ["a"])
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    t.merge(spark.range(7, 8).toDF("a"), lambda old, new: old.join(new, "a", "left_anti"))
    assert sorted(r["a"] for r in t.read().collect()) == [i for i in range(100) if i != 7]
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert sum(files.get(p) == m for p, m in after.items()) == 7  # only one bucket was written
    t.merge(spark.range(0).toDF("a"), lambda old, new: old.limit(0))
    assert t.read().count() == 99
    t.merge(t.read(), lambda old, new: old.filter("a = 3"))
    assert [r["a"] for r in t.read().collect()] == [3]  # buckets that lose all rows go


def test_trainer_log(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"log_history": [{"step": 1, "epoch": 0.5, "loss": 2.0}, {"step": 2, "epoch": 1.0, "eval_loss": 1.5}]}))
    got = {(r["step"], r["metric"]): r["value"] for r in X.read_trainer_log(spark, str(tmp_path / "s.json")).collect()}
    assert got == {(1, "loss"): 2.0, (2, "eval_loss"): 1.5}


def test_export_is_ranked(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") * 37 % 101).cast("int").alias("match_score"))
    X.export_matches(df, str(tmp_path / "e"))
    lines = [json.loads(x) for p in sorted((tmp_path / "e").glob("part*")) for x in p.read_text().splitlines()]
    assert [x["match_score"] for x in lines] == sorted((x["match_score"] for x in lines), reverse=True)


@pytest.mark.parametrize("master, named, warehouse, want", [("local[8]", None, "/a/w", "/a/w/_shared"), ("spark://h:7077", "s3a://b/c", "/a/w", "s3a://b/c"), ("spark://h:7077", None, "hdfs://n/w", "hdfs://n/w/_shared"),
                                                             ("spark://h:7077", None, "/a/w", None), ("yarn", None, "file:/a/w", None)])
def test_no_local_folder_on_a_cluster(master, named, warehouse, want):
    if want is None:
        with pytest.raises(ValueError):
            shared_root(master, named, warehouse)
    else:
        assert shared_root(master, named, warehouse) == want
