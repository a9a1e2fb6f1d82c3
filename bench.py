"""Headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the cores.  Each query is
built and run to its last row; the best of ``BENCH_RUNS`` runs counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from catalog import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "search_patterns",
    "search_whole_words",
    "only_matching_part",
    "count_per_file",
    "parse_rfc3164",
    "detect_formats",
    "filter_period",
    "extract_fields",
    "filter_fields",
    "rule_results",
    "app_counters",
    "pack_sshd",
    "pack_postfix",
    "number_table_lines",
    "fold_repeat_notices",
    "max_count_per_file",
    "context_lines",
    "thread_context",
    "whole_threads",
    "mask_fields",
    "name_addresses",
    "report_top_events",
    "report_totals",
    "report_sshd",
    "report_postfix",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
