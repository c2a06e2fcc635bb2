"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores (default all),
``BENCH_QUERIES`` a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickspark.plans import catalog  # noqa: E402
from tickspark.session import build_session  # noqa: E402

HEADLINES = [
    "flagship_flow_ranking",
    "s13_minute_vwap",
    "a01_p03_p04_market_orders",
    "w01_order_lags",
    "a16_candles",
    "a14_reference_windows",
    "j01_event_tick_range_join",
    "w04_standardise",
    "w06_median_fill",
    "m01_top_k",
    "m03_m04_top_k_percent_auc",
    "m08_pr_auc",
    "m10_model_curves",
    "m14_bootstrap_auc",
    "m15_paired_auc_test",
    "j02_asof_backward",
    "j04_leg_prices",
    "j05_nearest_minute_rate",
    "a17_candle_samples",
    "a22_lookback_fit",
    "x08_a25_a26_a27_backtest",
    "x08_backtest_with_impact",
    "j10_a29_size_sweep",
    "a30_portfolio_statistics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINES
    spark = build_session(
        f"local[{cpus}]",
        "tickspark-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog.PLANS["m01_top_k"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the executors
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.PLANS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    record = {
        "metric": "headline query wall-clock",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(record))


if __name__ == "__main__":
    main()
