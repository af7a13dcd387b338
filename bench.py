"""Times headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 4).
Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
QUERIES = (
    "detect_changes", "change_type_counts", "radar_changes", "latest_per_key", "institution_matrix", "divergence", "target_coverage", "themes",
    "diff_reports", "rating_search", "watchlist_view", "exact_search", "first_last_mention", "summary", "extract_mentions",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from marlstone import queries as engine

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in QUERIES:
        runs = []
        for k in range(RUNS + 1):
            began = time.perf_counter()
            engine.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.perf_counter() - began)
        took[name] = round(median(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
