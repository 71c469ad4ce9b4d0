"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select
the data and the local cores; BENCH_QUERIES may name a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spatiofuse.plans.catalog import QUERIES  # noqa: E402
from spatiofuse.session import local_session  # noqa: E402

HEADLINE = [
    "sensor_day_scan", "regulatory_daily", "forecast_daily_mean", "species_merge_proxy",
    "neighbor_features", "neighbor_features_per_fold", "nearest_cell_join", "idw_field_sampling", "idw_baseline",
    "morans_by_day", "strata_metrics", "bootstrap_ci", "kriging_baseline", "cross_fit_stack", "conformal_delta",
    "training_frame", "site_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]:.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
