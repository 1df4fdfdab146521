"""Time every catalog query once warm: one JSON line. ``$BENCH_SF_DIR`` names the tables,
``$BENCH_CPUS`` the cores, ``$BENCH_RUNS`` the timed runs per query (the median counts)."""

from __future__ import annotations

import json
import math
import os
import statistics
import time


def main() -> None:
    from tessera.plans.catalog import QUERIES
    from tessera.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name, query in QUERIES.items():
        times = []
        for run in range(runs + 1):
            began = time.perf_counter()
            query(spark, sf_dir).toArrow()
            if run:  # the first run compiles code and warms the file cache
                times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times), 4)
    mean = math.exp(statistics.fmean(math.log(max(s, 1e-4)) for s in seconds.values()))
    print(json.dumps({
        "metric": "geometric mean of median seconds per query", "value": round(mean, 4), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)), "cores": cores, "runs": runs, "total_sec": round(sum(seconds.values()), 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
