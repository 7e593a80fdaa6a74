"""Benchmark: seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once as warm-up (JIT, code generation, file listing) and is
then timed three times (the median counts); execution is forced with the ``noop`` sink, so the full
plan runs and nothing is collected to the driver.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricewise.plans import registry  # noqa: E402
from pricewise.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_fuel_profile",       # clean -> feature -> profile
    "e04_smooth_outliers_by_bin",  # exact-quantile bin smoother
    "d17_cramers_matrix",          # full association matrix
    "f05_f07_rolling_feature_series",  # gap-filled rolling and growth features per series
    "g03_lasso_cv",                # 5-fold lasso search
]
EXTRA = [
    "d04_describe",
    "a05_extract_key_values",
    "h02_score_requests_fixed",
    "f13_granger",
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16"))
    names = HEADLINE + ([] if os.environ.get("BENCH_HEADLINE_ONLY") else EXTRA)
    registry.load_all()
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=partitions, app="pricewise-bench")
    times = {}
    for name in names:
        run(spark, name, sf_dir)  # warm-up
        times[name] = round(median(run(spark, name, sf_dir) for _ in range(3)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times[n] for n in HEADLINE), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "shuffle_partitions": partitions,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
