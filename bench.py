"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["b03_dense_topk", "b04_sparse_topk", "b10_multi_query_topk", "a04_segments", "c02_status_rollup", "c03_profile", "c04_item_analysis", "d02_unpivot", "d09_last_wins", "e02_rollup", "f02_dead", "f26_bucket", "g03_consensus", "g05_dedup", "g36_islands", "h06_route", "i04_descendants", "j13_cube"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from corvana import catalog

    queries, took = catalog.queries(), {}
    queries["a14_counts"](spark, sf).write.format("noop").mode("overwrite").save()  # untimed: the JVM's start is no query's
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
