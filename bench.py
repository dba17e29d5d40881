"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to a no-op sink after one warm-up of the session; the value
is the sum of seconds.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = (
    "node_stats", "presence_matrix", "chunk_inverted_index", "include_overrides", "gitignore_last_match", "diff_first_sync", "diff_three_way", "resolve_newest", "resolve_by_rules",
    "transfers", "missing_chunks", "transfer_matrix", "sync_result", "snapshot_next", "dedup_stats", "metadata_differs_smart", "listing_round_trip", "latest_status_per_key", "cdc_chunks", "verified_replica_read", "reassemble",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from concordat.plans.catalog import QUERIES

    QUERIES["node_stats"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)


if __name__ == "__main__":
    main()
