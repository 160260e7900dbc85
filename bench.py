"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from lapforge.plans.registry import QUERIES
from lapforge.session import build_session

HEADLINE = [
    "clean_laps", "clean_report", "laps_with_context", "laps_with_weather", "dataset", "dataset_summary",
    "dataset_by_circuit", "fact_laps", "load_summary", "dataset_checks", "laps_page", "circuit_laps", "driver_laps",
    "dataset_stats", "circuit_averages", "performance_scores", "driver_profiles", "enriched_requests", "impute",
    "stratified_flag", "target_encoding", "derived_features", "match_candidates", "nearest_stations",
    "chosen_stations", "drift_by_column", "regression_metrics", "sliding_metrics", "held_condition", "page_circuits",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_suppkey").count().collect()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
