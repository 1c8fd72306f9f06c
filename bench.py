"""Seconds per headline query: ``BENCH_SF_DIR=... BENCH_CPUS=... python bench.py``.

Prints one JSON line. Every query writes its whole result to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog  # noqa: E402

HEADLINE = [
    "column_counts", "pair_counts", "set_counts", "set_counts_in_one_scan", "vocabulary", "build_dictionary",
    "dictionary_encoded", "group_sizes", "group_constancy", "violations", "given_fds",
    "single_fds", "prove_by_counts", "prove_by_groups", "equivalence_classes",
    "candidates_not_implied", "minimal_fds",
    "discover_geo", "discover_customer", "discover_part", "discover_orders", "discover_events",
    "discover_documents", "discover_conversations", "discover_lineitem8",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query would pay for starting the engine.
    catalog.QUERIES["discover_nation"](spark, sf_dir).collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
