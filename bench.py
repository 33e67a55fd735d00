"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed completely (written to Spark's ``noop`` sink, so every
row is produced but nothing is collected) and timed from plan construction to
the end of the write, including any fitting jobs it runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "profile_columns", "clean_table", "iqr_outliers", "fill_forward_backward", "one_hot", "standardize",
    "classification_metrics", "roc_auc", "confusion_matrix", "stratified_split", "silhouette",
    "assign_clusters", "npv_percentiles", "balance_bands", "route_arcs", "even_sample", "reorder_point",
    "bcg_quadrants", "weighted_scores", "findings_by_group", "ungrounded_numbers", "reward_curve",
    "bandit_sufficient_stats", "column_tags",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    from tablesight.plans.registry import queries
    from tablesight.session import get_spark

    spark = get_spark(app="tablesight-bench")
    qs = queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    # Warm-up, not timed: JVM start, parquet footer reads and codegen caches, so the
    # first headline query is not charged with session start-up.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
