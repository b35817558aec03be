"""Benchmark: wall time of the headline queries.

Runs each query to completion through Spark's ``noop`` sink (full execution,
nothing collected) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "series_time_features",   # per-series masked stats + masked first differences (chunked windows)
    "series_features_join",   # flagship: customers left-joined to their series vector
    "series_describe",        # per-series describe incl. exact quartiles
    "literature_features",    # cleaning rules + both derived-feature groups over the wide table
    "quantile_bins",          # exact quantile edges (chunked ranking) + right-closed bins
    "shared_codes",           # shared categorical codes over train and test
    "corr_importance",        # |r| of every feature in one aggregate
    "mutual_information",     # binned MI with partial aggregation
    "kendall_relevance",      # tau-b with chunked prefix sums + p-values
    "tune_cuts",              # kappa-maximising cut points over the candidate grid
    "stratified_folds",       # per-class chunked row numbers
    "interp_pchip",           # PCHIP interpolation with chunked neighbour carry
    "impute_median",          # exact median fill
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from fathom.plans.registry import QUERIES, load_all
    from fathom.session import local_session
    load_all()
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16,
                          app="fathom-bench")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    # warm-up: JVM start, class loading and codegen caches are not query cost
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
