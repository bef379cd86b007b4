"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

from sparkloom.plans import queries as plans

HEADLINE = [
    "hybrid_search", "bm25_topk", "vector_topk", "demoted", "raw_chunks", "stub_embedding", "passage_paths", "hash_diff", "agent_stats",
    "interval_merge", "recall_mrr", "pagerank", "grep_lines", "grounding", "debounce_sessions", "latency_percentiles",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("content_hash", "sql_embedding"):  # the JVM's and Python's workers start before the clock does
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    chunks = plans.QUERIES["raw_chunks"](spark, sf_dir).count()
    queries = plans.table(spark, sf_dir, "benchmark").count()
    rates = {"chunks_per_s": round(chunks / times["raw_chunks"], 1), "hybrid_queries_per_s": round(queries / times["hybrid_search"], 1)}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None, "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
