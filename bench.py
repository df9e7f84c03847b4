"""Times the headline queries on one machine and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma separated names, or ``all``). Every query is run in full into a sink that
drops the rows; cached tables are cleared in between, so no query profits from an earlier one.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wellspan.plans.catalog import ENTRIES  # noqa: E402
from wellspan.session import build_session  # noqa: E402

HEADLINE = [
    "weather_clean_daily", "weather_left_join_obs", "history_upsert_last", "dedupe_first_reading",
    "missing_dates", "interpolated_daily", "water_balance_features", "centered_ma_7_365",
    "monthly_resample_mean_sum_last", "spli_monthly", "spli_supplier_network", "index_panel_scales",
    "index_broadcast_daily", "causal_index_asof", "drought_events", "event_extremes_by_scale",
    "heatwave_days", "compound_dry_hot", "ccf_drivers", "best_recharge_lag", "classical_decomposition",
    "robust_decomposition", "corr_matrix_long", "exact_quantiles_prices", "daily_feature_table",
    "train_frame_h14", "walk_forward_folds", "cv_summary", "ols_lagged_backtest", "additive_backtest",
    "stream_daily_mean", "holt_winters_grid", "grid_select_score", "refit_forecast_index", "gbt_backtest",
    "feature_table_raw_readings", "stream_upsert_last",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(ENTRIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # JVM and reader start-up
    times: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
