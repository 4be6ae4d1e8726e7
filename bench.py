"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

``value`` is the sum of the per-query medians. Each query runs once to warm up, then BENCH_RUNS times
(default 3; long planners run once) with its whole result written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = [
    "agg01_use_stats", "agg02_degree", "agg09_throttled_lists", "flt11_spanning_topics", "flt12_under_replicated", "jn03_merge_brokers",
    "jn04_add_back_storage", "jn08_overlay_reassignments", "jn09_reassigning_replicas", "scl11_what_changed", "win01_largest_partitions",
    "win03_latest_values", "src01_map_documents", "src11_checkpoint_log", "pln12_chunk_changes", "pln15_validate_plan",
    "str01_network_averages", "str04_applied_rates", "str10_offset_translation",
]
LONG = ["pln01_place_by_count", "pln01_place_by_storage", "pln02_repair_placement", "pln05_leadership_invariants", "pln07_relocation_plan"]


def main() -> None:
    from pyspark.sql import SparkSession

    from replicalens.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("replicalens-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - t

    times: dict[str, float] = {}
    for name in HEADLINE:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    for name in LONG:
        times[name] = round(once(name), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
