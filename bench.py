"""Times the headline jobs. Prints one JSON line.

Each job runs once to warm up; its figure is the median of three further runs, or one further run where
the first took over five seconds. ``BENCH_ALL=1`` times every registered job instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from demandloom.plans.registry import load
from demandloom.session import local_session

HEADLINE = [
    "s4_validated_rows", "s6_find_or_create", "s8_fact_upsert", "s25_wide_export", "f5_sales_page", "f9_all_facets",
    "a1_monthly_demand", "a1_quarterly_demand", "a3_all_levels", "a6_dashboard_totals", "a8_field_summaries", "a14_latency_rollup",
    "t1_series_profile", "t10_feature_matrix", "m1_linear_trend", "m3_smoothing_regression", "m6_holt_winters", "m9_decomposition",
    "m10_knn", "x1_evaluate", "x3_best_fit", "x6_copy_job", "d1_history_ratios", "d4_multi_table", "d7_apply_ratios", "k4_pair_metrics",
]

LONG = 5.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, cores)
    queries, _ = load()
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM
    times: dict[str, float] = {}

    def once(name: str) -> float:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - start

    for name in names:
        runs = 3 if once(name) < LONG else 1
        times[name] = round(median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"), "cores": int(cores), "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
