"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, medians of three runs after one to warm up, in seconds."""

from __future__ import annotations

import json
import os
import re
import time
from statistics import median

from pyspark.sql import SparkSession

HEADLINE = [
    "describe_owned", "describe_groups", "time_bins", "series_edges", "lysis_events", "lineage_rollup", "repeat_ranks", "replicate_numbers",
    "normalised_to_control", "mask_comparison", "segmentation_errors", "nearest_in_previous", "growth_slopes", "plate_reader_table", "growth_rates",
]


def main() -> None:
    place = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from trackfold.plans.catalog import QUERIES

    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2 if name == "growth_rates" else 4):
            began = time.time()
            QUERIES[name](spark, place).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(median(runs[1:]), 3)
    found = re.search(r"sf([\d.]+)", place)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(found[1]) if found else None}))


if __name__ == "__main__":
    main()
