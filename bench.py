"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores. Each query is run once
untimed on the whole input, so that code generation and file listing are not counted, and then
``BENCH_REPEAT`` times; the best time counts. Results go to a sink that reads every row.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tradeaxis.plans.registry import callables
from tradeaxis.session import get_spark

HEADLINE = (
    "a11_bars_window",
    "e09_coverage_report",
    "f01_first_quote_wins",
    "f07_upsert_bars",
    "f13_upsert_assets",
    "g02_latest_failed_runs",
    "g14_latest_ready",
    "h01_missing_positions",
    "h05_incomplete_by_session",
    "j01_dense_prices",
    "j08_content_digest",
    "k06_run_states",
    "l02_position_view",
    "l14_weight_after",
    "e18_plan_totals",
    "a07_rate_pages",
    "m04_catch_up",
    "m06_late_arrivals",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = callables()
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        best = float("inf")
        for turn in range(repeat + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if turn:
                best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, best wall time, summed",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
