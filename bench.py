"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed in full with the ``noop`` sink (no collect).
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e4_churn_by_contract", "e1_correlation_matrix", "e2_histogram", "e11_numeric_stats",
    "q8_quality_score", "v2_v7_validation_errors", "v12_duplicate_ids", "p11_apply_to_new_rows",
    "m7_classification_metrics", "m9_roc_auc", "x1_x3_batch_score", "x6_local_contributions",
    "x7_top_contributors", "d1_kpis", "d3_monthly_trend",
    "f1b_neighbour_information", "x15_same_input_reuse", "st2_stream_over_limit",
    "x4_shapley_sampling", "x5_tree_shapley",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidemark.session import get_spark
    from tidemark.plans.catalog import load_all
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2)
    reg = load_all()
    times = {}
    t_all = time.time()
    for name in HEADLINE:
        t0 = time.time()
        reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(time.time() - t_all, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
