"""Benchmark: every registered query at one scale, one JSON line on stdout.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of cores. The
shared stored tables are built first and timed as ``prepare_*``; the queries that
read them follow. Both count towards the total. ``throughput`` puts the cleaning
and the summaries of the trips into rows per second.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from spokeframe.plans import REPORTS, RideTables  # noqa: E402
from spokeframe.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))

PREPARE = {
    "prepare_trips": lambda t: t.trips(),
    "prepare_clean_rides": lambda t: t.rides(),
    "prepare_ride_facts": lambda t: t.facts(),
    "prepare_start_counts": lambda t: t.counts("start"),
    "prepare_end_counts": lambda t: t.counts("end"),
    "prepare_start_activity": lambda t: t.activity("start"),
    "prepare_end_activity": lambda t: t.activity("end"),
    "prepare_monthly_csv": lambda t: t.month_files(),
}


def main() -> None:
    spark = local_session(
        CPUS,
        "spokeframe-bench",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock

    tables = RideTables.from_lineitem(spark, SF_DIR)
    seconds: dict[str, float] = {}
    for name, prepare in PREPARE.items():
        began = time.perf_counter()
        prepare(tables)
        seconds[name] = round(time.perf_counter() - began, 3)
    for name, report in REPORTS.items():
        began = time.perf_counter()
        report(tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)

    trips = tables.trips().count()
    pipeline = seconds["prepare_clean_rides"] + seconds["prepare_ride_facts"]
    print(
        json.dumps(
            {
                "metric": "seconds for all trip tables and reports",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "trips": trips,
                "throughput": {"clean_and_summarise_rows_per_sec": round(trips / pipeline)},
                "cpus": CPUS,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
