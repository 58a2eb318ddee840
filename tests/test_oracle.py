"""A part of the registry against SQL on the smallest tables, in both forms of the ordered scan."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.sources.tables import TABLES
from tools.check_oracle import rows_of

NAMES = ["assign_week", "temporal_split", "stratified_folds", "ks_test", "benjamini_hochberg", "reference_edges", "psi", "js_distance", "sequence_features", "ordinal_encode",
         "frequency_encode", "ddm", "eddm", "hddm", "adwin_halves", "auc", "tune_threshold", "upsert_matches", "list_jobs", "apply_match_replies", "render_chat", "assemble_dialogue",
         "web_content", "performance_matrix", "replay_actions", "week_method_matrix", "cluster_drift_fixed_centres"]


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("form", ["one", "chunked"])
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, small, con, name, form):
    if form == "chunked":
        spark.conf.set("spark.tidemark.chunks", "5")
    try:
        df = entry.queries()[name](spark, small)
        got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)
    finally:
        spark.conf.unset("spark.tidemark.chunks")
    rel = con.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(rel.fetchall(), columns=[c[0] for c in rel.description])
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["week", "method", "features_total", "features_crossed", "fraction", "raw_flag"] and df.count() > 0
