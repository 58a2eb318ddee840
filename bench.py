"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from tidemark import workload  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    "assign_week", "bounded_sample", "sequence_features", "group_aggregate_encode", "frequency_encode", "ordinal_encode",
    "ks_test", "psi", "psi_null", "js_distance", "drift_votes", "ddm", "eddm", "hddm", "auc", "prequential_auc",
    "tune_threshold", "performance_matrix", "evaluate_policies", "policy_reward", "week_method_matrix", "cluster_drift_fixed_centres",
    "upsert_matches", "list_jobs", "apply_match_replies", "generate_samples", "validate_documents", "render_chat",
    "spearman_matrix", "train_classifier", "random_action_control", "null_alarms", "stream_ddm",
    "signal_pairs", "select_features", "temporal_split",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="bench")
    queries, times = workload.queries(), {}
    spark.read.parquet(f"{folder}/nation.parquet").count()
    for name in only:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
