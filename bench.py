"""Time the headline queries: one JSON line with the median of three warm runs each."""

from __future__ import annotations

import json
import os
import statistics
import time

from longspark.catalog import load
from longspark.session import build_session

HEADLINE = [
    "history_inclusive",
    "history_strict",
    "horizon_label",
    "cohort_sequences",
    "forecast_examples",
    "evaluate",
    "nearest_asof",
    "apply_missingness",
    "benchmark_cells",
    "fit_ridge_grouped",
    "summarize",
    "primary_gate",
    "bootstrap_mean_ci",
    "crossed_permutation",
    "safe_corr",
    "diff_numeric",
    "content_hash",
]
RUNS = 3


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = build_session("bench", cores=cores, **{"spark.sql.shuffle.partitions": cores})
    queries, _ = load()
    times = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        seconds = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seconds[1:]), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
