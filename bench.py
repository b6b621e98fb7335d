"""Benchmark: headline queries on $BENCH_SF_DIR (default sf0.1), local[$BENCH_CPUS].

Each query's full plan is executed with the ``noop`` sink (no collect to the
driver); the time is the wall time of that one action, including any
deferred checks and checkpoints the query runs.  Prints one JSON line.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.plans import catalog  # noqa: E402
from tablewright.session import get_session  # noqa: E402

HEADLINE = [
    "pricing_summary", "shipping_top10", "filter_and", "filter_range", "sort_multi", "top_k", "dedup_keys",
    "join_left", "join_full", "union_name", "group_multi", "min_max_text", "group_text_sum", "cast_modes",
    "clean_text", "profile", "type_census", "saved_run", "csv_round_trip", "jsonl_round_trip", "parquet_round_trip",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    names = sys.argv[1:] or HEADLINE
    # warm-up on the smallest data set (same code paths, tiny input): JVM JIT,
    # codegen and Python worker start-up are not charged to the first query.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in ("pricing_summary", "sort_multi", "profile", "csv_round_trip", "jsonl_round_trip"):
        catalog.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time_headline_queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
