"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose data and
cores. A query's time is the best of BENCH_RUNS (default 2) full executions: every row is
computed by the no-op sink, none is collected.
"""

import json
import os
import time

from gridspark.queries import QUERIES
from gridspark.session import build_session

HEADLINE = [
    "a05_budget_with_bands", "a05_annual_totals", "a07_monthly_climatology", "a13_ensemble_mean", "a15_ensemble_bands",
    "a19_moments", "a20_merge_moments", "a25_robust_limits", "t14_hold_to_daily", "g03_regrid_bilinear", "m06_apply_mask",
    "m07_split_longitude_bands", "j04_reindex", "j09_broadcast_climatology", "w01_rolling_mean_30_months",
    "w07_stock_from_december", "w09_linear_trend", "w15_interannual_variability", "h02_spatial_fill", "h04_climatology_fill",
    "d06_water_residual", "d11_balance_scores", "n01_standardise", "n05_assemble_samples", "r01_rollout_affine",
    "r01_rollout_predictor", "r07_nudge_states", "k05_metric_table", "k06_cell_metrics", "q01_uniform_sample", "c01_missing_report",
    "x05_training_log_batches", "s01_read_field", "st01_running_moments",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executors
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 4)
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(times.values()), 4), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
