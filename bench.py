"""Headline queries on one scale factor: prints one JSON line with the seconds of each query and their sum."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scorefold.plans import load_all
from scorefold.plans.registry import QUERIES
from scorefold.session import local_session

HEADLINE = [
    "collapse_daily", "day_pairs", "build_items", "persistence_by_state", "count_cause_state_year", "largest_fire_name", "best_constant", "stratified_sample",
    "pair_arms", "parse_typed_answer", "failure_table", "regression_scores", "binary_scores", "average_precision", "auroc", "spearman", "calibration",
    "isotonic", "leave_group_out_threshold", "eligible_pairs", "retrieve_band", "retrieve_ladder", "retrieve_nn_pers_chg", "bootstrap_mean", "bootstrap_ap",
    "stratified_contrasts", "asof_matched_gap", "fingerprint_match",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_CPUS", "8")), app="scorefold-bench")
    load_all()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderstatus").count().write.format("noop").mode("overwrite").save()  # JVM warm-up
    took = {}
    for n in names:
        t = time.perf_counter()
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
