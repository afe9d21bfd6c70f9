"""Benchmark the headline reports.

Runs each report over the whole sf tables at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line.
Each query is executed fully with the ``noop`` sink (no collect to the
driver); the value is the total wall time of all queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlake.operators import accounts, balance, categorize, merchants, outliers, quality, stats, temporal  # noqa: E402
from ledgerlake.plans.catalog import AS_OF_EVENTS, AS_OF_ORDERS  # noqa: E402
from ledgerlake.session import local_session  # noqa: E402
from ledgerlake.sources import adapters  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="ledgerlake-bench")
    li = adapters.lineitem_transactions(spark, sf_dir)
    od = adapters.orders_transactions(spark, sf_dir)
    ev = adapters.events_transactions(spark, sf_dir)

    def categorised():
        out, _cats = categorize.categorize(li)
        return categorize.categorisation_stats(out)

    plan = {
        "basic_statistics": lambda: stats.basic_statistics(li),
        "monthly_summary": lambda: temporal.monthly_summary(li),
        "trend_weekly": lambda: temporal.trend_weekly(li),
        "account_financials": lambda: accounts.account_financials(li),
        "activity_accounts": lambda: accounts.activity_accounts(od, as_of=AS_OF_ORDERS),
        "top_merchants": lambda: merchants.top_merchants(li),
        "missing_data": lambda: quality.missing_data(li),
        "iqr_outliers": lambda: outliers.iqr_outliers(li),
        "duplicates": lambda: outliers.duplicates(li),
        "balance_check": lambda: balance.balance_check(ev),
        "activity_summary_events": lambda: accounts.activity_summary(ev, as_of=AS_OF_EVENTS),
        "categorize": categorised,
    }
    # warm-up: JVM + parquet footer caches
    stats.overview(li).write.format("noop").mode("overwrite").save()
    times = {}
    for name, build in plan.items():
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "report_suite_wall_time", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
