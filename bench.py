"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

# from raw rows to labels, panel, features, statistics, metrics, rules and queue
HEADLINE = ["labels_gap_orders", "labels_attach_client", "panel_orders_features", "panel_events", "features_dense", "features_transaction_count",
            "features_sparse_other_table", "features_category_freq", "stats_auc", "stats_quantiles", "stats_youden_many_values", "metrics_threshold_curve",
            "metrics_auc_by_k", "metrics_alarm_performance", "explore_compare_points", "rules_grid", "queue_priority", "explain_suggested_action",
            "schema_containment", "selection_univariate_auc"]


def main() -> None:
    from pyspark.sql import SparkSession

    from ebbtide.queries import QUERIES
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["labels_gap_events"](spark, sf_dir).write.format("noop").mode("overwrite").save()   # start the workers
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
