"""Benchmark the headline queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3: the median of so many runs, after one warm-up of the session).
Each query is fully executed with a ``noop`` write (no driver collection).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from seriesspark.plans.catalog import QUERIES  # noqa: E402
from seriesspark.session import build_session  # noqa: E402
from seriesspark.sources.tables import Tables  # noqa: E402

HEADLINE = ["seller_monthly_panel", "lag_features", "window_arrays", "cv_naive", "cv_metrics",
            "corr_matrix", "mint_shrink", "hier_levels", "naive_intervals", "fill_gaps_global",
            "rolling_stats", "differenced_features"]


def _daily_windows(spark, sf_dir):
    """Daily panel, input 104, horizon 52, a window per day."""
    from seriesspark.operators.windows import window_arrays
    from seriesspark.plans.catalog import daily_filled
    return window_arrays(daily_filled(Tables(spark, sf_dir)), 104, 52, 1)


def _daily_cv(spark, sf_dir):
    """Daily panel, horizon 7, 4 windows, season 7."""
    from seriesspark.operators.forecast import cross_validation
    from seriesspark.plans.catalog import daily_filled
    return cross_validation(daily_filled(Tables(spark, sf_dir)), 7, 4, "D", 7, ("Naive", "SeasonalNaive"), 7)


def _daily_cv_metrics(spark, sf_dir):
    from seriesspark.functions.contracts import DEFAULT
    from seriesspark.operators.evaluation import evaluate, summarize
    ev = evaluate(_daily_cv(spark, sf_dir), ["Naive", "SeasonalNaive"], ("mae", "mape", "rmse", "smape"), DEFAULT, extra_keys=("cutoff",))
    return summarize(ev, ["Naive", "SeasonalNaive"])


def _corr_100(spark, sf_dir):
    """Correlations of 100 daily supplier series."""
    from seriesspark.operators.analysis import corr_matrix
    from seriesspark.operators.relational import first_ids
    from seriesspark.plans.catalog import daily_filled
    panel = daily_filled(Tables(spark, sf_dir))
    return corr_matrix(panel, first_ids(panel, "unique_id", 100))


LARGE = {"window_arrays_daily_104_52": _daily_windows, "cv_naive_daily": _daily_cv, "cv_metrics_daily": _daily_cv_metrics,
         "corr_matrix_100": _corr_100, "gbt_forecast": QUERIES["gbt_forecast"]}
# Fitting 30 boosted trees takes minutes: one run.
ONCE = ("gbt_forecast",)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", max(8, cpus),
                          extra={"spark.driver.memory": "16g",
                                 "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024)})
    # warm-up: JVM, Python workers, file listing
    QUERIES["monthly_series"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, began = {}, time.time()
    for name in [*HEADLINE, *LARGE]:
        fn = LARGE.get(name) or QUERIES[name]
        took = []
        # after BENCH_SECONDS the entries left are run once each
        for _ in range(1 if name in ONCE or time.time() - began > float(os.environ.get("BENCH_SECONDS", "420")) else runs):
            t0 = time.time()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - t0)
        times[name] = round(statistics.median(took), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus}))


if __name__ == "__main__":
    main()
