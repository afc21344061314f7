"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR  data directory (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shoalmark.plans import catalog  # noqa: E402

HEADLINE = [
    "index_wide_report",
    "trawl_index",
    "longline_index",
    "dataset_bundle",
    "catch_totals",
    "catch_vs_limit",
    "length_comp_by_year",
    "length_comp_by_stratum",
    "fishery_length_comp",
    "box_stats",
    "length_by_depth",
    "depth_profile",
    "station_catch",
    "points_in_strata",
    "apportionment",
    "harvest_spec",
    "strata_correlation",
    "relative_error",
    "quantile_grid",
    "posterior_qq",
    "posterior_summary",
    "scenario_fanout",
    "smooth_index",
    "retrospective_peels",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # One run outside the clock starts the executor threads and warms the file cache.
    catalog.QUERIES["trawl_index"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    sf = float(sf) if sf.replace(".", "", 1).isdigit() else sf
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
