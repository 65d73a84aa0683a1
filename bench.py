"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quern.plans import catalogue

NAMES = (
    "count_filter", "group_sum", "top_n", "by_day", "distinct_count", "page_values", "aggregate_all", "having", "annotate_count",
    "exists_annotation", "case_when", "window_rank", "complex_filter", "top_ten", "filter_icontains", "large_in", "revenue_by_nation",
    "asof_join", "rollup", "window_filter", "lateral_top2", "two_branches", "knn_cosine",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = catalogue.queries()
    took = {}
    for name in NAMES:
        best = []
        for _ in range(3):  # the first run compiles; the median counts
            began = time.perf_counter()
            run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        took[name] = round(sorted(best)[1], 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
