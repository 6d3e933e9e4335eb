"""Time the headline queries: one JSON line on standard output.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "cycle_average", "complex_maps", "retinotopy", "gaussian_smooth", "label_components_4", "capture_quality",
    "agreement", "attach_cycle", "threshold_sweep", "stale_stages", "complex_maps_rectified", "skeletonize", "basin_assign",
]


def main() -> None:
    from phasemill.catalog import QUERIES
    from phasemill.session import local_session

    names = sys.argv[1:] or HEADLINE
    spark = local_session(CPUS)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    cold, times = {}, {}
    for name in names:
        for into in (cold, times):  # the first run compiles, the second is the figure
            t = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            into[name] = round(time.perf_counter() - t, 3)
    m = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "first_run": cold, "sf": float(m.group(1)) if m else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
