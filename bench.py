"""

Runs J1, A3, A6, T2, R8, D3 and R2 on `$BENCH_SF_DIR` (default
/root/testdata/sf0.1) with `local[$BENCH_CPUS]`: one warm-up and three
timed runs each, median reported. Each run executes the full plan into
the no-op sink (nothing is collected). The ratings table is derived from
lineitem x orders and stored once per application (as the reference loads
it once); that ingest is timed on its own as `ingest_ratings`. R8 includes
fitting the model (biases + ALS) on the filtered ratings. Prints one JSON
line; `value` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "filter_active_popular": "J1",
    "popularity_stats": "A3",
    "data_statistics": "A6",
    "top_genre_popular": "T2",
    "recommend_users": "R8",
    "ks_drift": "D3",
    "fit_knn": "R2",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from reelrank.plans.registry import QUERIES
    from reelrank.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    timings = {}
    # Ingest: derive the ratings table from lineitem x orders and store it
    # (done once per application by the queries below; timed separately).
    from reelrank.session import scratch_path
    from reelrank.sources.driver import model, write_ratings
    m = model(spark, sf_dir)
    samples = []
    for i in range(runs + 1):
        t0 = time.perf_counter()
        write_ratings(m.derive_ratings(), scratch_path(spark, "bench-ratings"))
        if i > 0:
            samples.append(time.perf_counter() - t0)
    timings["ingest_ratings"] = round(statistics.median(samples), 3)
    # R8 with the fit of its model (the registered recommend_users runs on a stated factor table)
    timed = {**QUERIES, "recommend_users": QUERIES["recommend_batch"]}
    for key in HEADLINE:
        fn = timed[key]
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                samples.append(dt)
        timings[key] = round(statistics.median(samples), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_query_median_seconds_sum",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
