"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm up, then ``BENCH_REPEATS`` (default 3) times;
the median is reported.  Every run executes the whole plan through the
``noop`` sink (all rows produced, nothing collected to the driver).  Prints
one JSON line: {"metric", "value" (sum of medians), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "demand_forecast",          # E1 end to end (flagship)
    "seasonality_robust",       # C8 windows
    "seasonality_profile",      # C8 profile aggregate
    "fill_weeks_6key",          # C4 gap fill, 6 keys
    "promo_flag",               # C1 + C2
    "item_clusters",            # C10
    "forecast_level_seasonal",  # C5 + C7
    "forecast_mean4",           # C12
    "seasonality_simple_profile",  # C9
    "week_index",               # C11
    "promo_lookup",             # C14
    "key_overlay_first",        # C13
    "group_stats",              # C17
    "partition_ratio",          # W1/W2
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE

    from weekcast.plans.queries import QUERIES
    from weekcast.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    out = {}
    for name in names:
        fn = QUERIES[name]
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times = []
            for _ in range(repeats):
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - t0)
            out[name] = round(statistics.median(times), 3)
            print(f"# {name}: {out[name]:.3f}s", file=sys.stderr, flush=True)
        except Exception as e:  # keep measuring the others; the failure is reported
            out[name] = None
            print(f"# {name}: FAILED {type(e).__name__}: {str(e)[:300]}", file=sys.stderr,
                  flush=True)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    total = round(sum(v for v in out.values() if v is not None), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": out, "sf": sf,
                      "failed": sorted(k for k, v in out.items() if v is None)}))
    spark.stop()


if __name__ == "__main__":
    main()
