"""Times the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from peregrin.plans import catalogue
from peregrin.session import get_session

HEADLINE = ["rrf_fusion", "bm25_topk", "cosine_topk", "graph_near_edges", "nearest_hub", "graph_search_routed", "crowding_zscore", "holt_winters_fixed", "holt_winters_fitted", "seasonal_naive_backtest", "centroid_classify", "destination_score", "travel_mode_legs", "day_schedule", "multi_day_itinerary", "diversify_round_robin", "fame_percentile", "recall_precision", "plan_trip"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(cpus, int(cpus), "8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalogue.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "sum of warm query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "median": round(statistics.median(times.values()), 3), "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
