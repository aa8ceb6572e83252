"""Prints one JSON line with the seconds of the headline queries. Each runs once before it is timed, so that code is compiled."""

import json
import os
import time

from pyspark.sql import SparkSession

from sparkledger.plans import registry

NAMES = ["replay", "multi_get", "leveled_read", "full_compaction", "compact_level", "streaming_ingest", "generated_workload", "generated_workload_1000", "memtable_size"]
#: What counts as an operation, for rates: mutations of the log, or generated operations.
OPERATIONS = {"generated_workload": 50_000, "generated_workload_1000": 50_000}


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    for name in NAMES:
        for _ in range(2):
            start = time.time()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - start, 3)
    rates = {name: round(OPERATIONS.get(name, events) / seconds) for name, seconds in took.items()}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "operations_per_sec": rates, "sf": sf}))


if __name__ == "__main__":
    main()
