"""Benchmark of the headline queries.

Runs each query once to warm up, then three timed runs, each to the
``noop`` sink (the whole plan executes, nothing is collected to the
driver), and prints one JSON line with the median seconds per query.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trafficscore.plans.catalog import QUERIES  # noqa: E402
from trafficscore.plans.strategies import released_after  # noqa: E402
from trafficscore.session import build_session  # noqa: E402

HEADLINE = [
    "compute_rfm", "customer_rfm", "classify_clients", "packet_tsv_parse", "rfm_raw_packets",
    "percent_ranks", "percent_ranks_histogram", "score_rfm", "suspicion_verdict",
    "rate_limit", "decide_requests",
]


def run(spark, name, sf):
    t = time.perf_counter()
    with released_after():      # each run builds (and then drops) its own cached tables
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app_name="trafficscore-bench", shuffle_partitions=cpus)
    # a plain scan and count of the same table tells a slow host from slow code
    events = f"{sf}/events.parquet"

    def calibrate():
        t = time.perf_counter()
        spark.read.parquet(events).groupBy("event_type").count().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    calibrate()
    calibration = round(statistics.median(calibrate() for _ in range(3)), 3)
    times = {}
    for name in names:
        run(spark, name, sf)
        times[name] = round(statistics.median(run(spark, name, sf) for _ in range(3)), 3)
    sf_label = sf.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "median_query_seconds_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_label, "cpus": cpus,
                      "calibration_scan_sec": calibration, "spark": spark.version, "driver_memory": spark.conf.get("spark.driver.memory", "default"),
                      "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}))
    spark.stop()


if __name__ == "__main__":
    main()
