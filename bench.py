"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores), BENCH_RUNS (default 3, the median counts;
fewer runs once BENCH_BUDGET_SEC, default 240, is used up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from worklake.registered import all_queries

HEADLINE = [
    "contract_reasons", "split_valid_quarantine", "recon_received", "recon_duplicates", "latest_per_key", "scd1_current",
    "latest_event", "is_latest_global", "join_left_order", "join_report_study", "heads_long", "triage_arbitrate", "queue_fifo",
    "queue_triage", "outcome_class", "daily_summary", "daily_model_summary", "v_band_daily", "v_silent_trial",
    "cross_view_differences", "group_split", "balanced_sample", "check_dup_content", "array_stats", "score_heads", "psi",
    "auroc", "quality_reference", "kpi_gate", "read_psv_trailer", "replace_partitions"]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs, budget = int(os.environ.get("BENCH_RUNS", "3")), float(os.environ.get("BENCH_BUDGET_SEC", "240"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("worklake-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # JVM warm-up
    times: dict[str, list[float]] = {}
    begun = time.perf_counter()
    for run in range(runs):
        for name in HEADLINE:
            if run and time.perf_counter() - begun > budget:
                break
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.setdefault(name, []).append(time.perf_counter() - start)
            print(f"{name} {times[name][-1]:.2f}", file=sys.stderr)
    medians = {n: round(statistics.median(t), 3) for n, t in times.items()}
    print(json.dumps({"metric": "headline queries, sum of median seconds", "value": round(sum(medians.values()), 3), "unit": "sec",
                      "queries": medians, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
                      "spark": spark.version, "runs": {n: len(t) for n, t in times.items()}}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
