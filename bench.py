"""Benchmark: runs the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query's full plan is executed with the ``noop`` sink (every row is
produced, nothing is collected) and timed.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "master",
    "pivot_rate",
    "missing_report",
    "duplicate_keys",
    "describe",
    "corr_matrix",
    "rate_by_category",
    "daily_series",
    "seasonal_decompose",
    "lag_features",
    "impute_scale",
    "feature_defaults",
    "roc_auc",
    "risk_profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from wardline.session import builder

    spark = builder(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from wardline.plans.registered import REGISTRY

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total_latency",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
