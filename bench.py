"""Times the headline queries and prints one JSON line. Each query is counted to its last row by Spark's noop sink."""

import json
import os
import time

from pyspark.sql import SparkSession

from tracelake import registry

NAMES = (
    "a1_slow_queries_total", "a2_locks_hour", "a4_process_roles", "a5_duration_histogram", "a6_events_feed", "a7_top_operations_total_duration", "a8_heatmap_count", "a9_operation_summary", "a13_compare_summary",
    "a14_in_both", "a15_load_operations", "a16_regressions", "k2_longest", "x17_edges", "f4_surrounding", "w4_islands", "w5_hour_load", "j_many", "j_as_of", "g_pricing", "g_rollup", "w_row_number",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, warm, cold = registry.queries(), {}, {}
    for name in NAMES:
        for times in (cold, warm):  # the first run compiles the code
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline queries, warm total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "slowest": max(warm.values()),
        "sf": float(folder.rstrip("/").rpartition("sf")[2]) if "sf" in folder else folder, "cpus": int(cpus), "shuffle_partitions": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
