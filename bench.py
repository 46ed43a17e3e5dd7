"""Headline queries, timed: one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

from caseledger.plans.catalog import QUERIES
from caseledger.session import build_session

HEADLINE = [
    "d22_operating_points", "e1_rank_within_case", "e4_greedy_first_match", "d25_locked_threshold_metrics",
    "d18_roc_auc", "d20_roc_curve", "d27_metric_summary", "d29_source_separated_table", "d8_exact_percentiles",
    "d30_lesion_size_strata", "d34_stratified_bootstrap", "d36_cluster_bootstrap_difference", "f3_top_candidates_per_case",
    "e5_keep_last", "c1_one_to_one_join", "c7_paired_arms", "c11_point_to_set_distance", "c12_radius_gate_large_volume",
    "h8_policy_comparison", "h13_regrid_to_crop", "h15_tile_merge", "h22_candidate_generator", "i3_streaming_ledger",
    "j3_hash_chain",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    names = [n for n in HEADLINE if len(sys.argv) < 2 or any(n.startswith(a) for a in sys.argv[1:])]
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
