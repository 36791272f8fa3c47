"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (every row is
computed, nothing is collected to the driver); the time is the best of
$BENCH_REPEAT runs after one warm-up. Prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

BENCH_QUERIES=all runs every registered query instead of the headline set.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "trip_catalog",                # J5 flagship
    "trip_detail",                 # J6
    "trip_batch_pages",            # W2
    "booking_detail_flat",         # J1
    "admin_bookings",              # J3
    "batch_occupancy",             # A2
    "batch_roster",                # A4
    "batch_roster_entries",        # A4
    "user_trips",                  # A5
    "trips_with_batches",          # A6
    "coupon_status",               # J9
    "trip_media",                  # J10
    "trip_itinerary_file",         # J11
    "sample_trip_images",          # W3
    "validate_bookings",           # M5
    "admit_bookings",              # M6
    "update_bookings_table",       # M9
    "delete_trips_bookings",       # M10
    "orphan_media",                # M15
    "constraint_report",           # S6
    "admin_trips_page",            # O1
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from caravan.plans.registry import queries
    from caravan.session import build_session

    scratch = tempfile.mkdtemp(prefix="caravan-bench-")
    spark = build_session(f"local[{cpus}]", app="caravan-bench",
                          shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(int(cpus) * 2))),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "4g"),
                                 "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                                 "spark.sql.warehouse.dir": os.path.join(scratch, "wh")})
    spark.sparkContext.setLogLevel("ERROR")
    qs = queries()
    names = sorted(qs) if os.environ.get("BENCH_QUERIES") == "all" else [n for n in HEADLINE if n in qs]
    times: dict[str, float] = {}
    for name in names:
        best = None
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_best_of_%d" % repeat,
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
