"""All reports of a year of trip files: ``spark-submit … -m spokeframe TRIPS OUT``.

``TRIPS`` holds the twelve monthly CSV files; every report is written to
``OUT/<name>`` as CSV, the six map tables with a leading row number. ``--work`` names
a folder that all executors share; without one, and without ``spark.checkpoint.dir``,
a cluster computes the shared tables anew for every report.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import REPORTS, RideTables, write_map_tables
from .sinks import write_csv

# Row-level tables: the size of the input, so only on request.
TRIP_TABLES = (
    "trips_union_all",
    "trips_drop_na",
    "trips_calendar",
    "trips_ride_length",
    "trips_ride_distance",
    "trips_ride_speed",
    "clean_rides",
)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spokeframe", description="Reports over a year of bike-share trips")
    parser.add_argument("trips", help="folder of the twelve monthly CSV files")
    parser.add_argument("out", help="folder for the reports; must not hold reports yet")
    parser.add_argument("--report", action="append", help="only this report (repeatable)")
    parser.add_argument("--trip-tables", action="store_true", help="also write the row-level tables")
    parser.add_argument("--work", help="shared folder for the tables that reports have in common")
    options = parser.parse_args(arguments)

    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
    if options.work:
        builder = builder.config("spark.checkpoint.dir", options.work)
    spark = builder.getOrCreate()
    tables = RideTables.from_csv(spark, options.trips)
    folder = options.out.rstrip("/")
    names = options.report or [
        name
        for name in REPORTS
        if not name.startswith("sink_") and (options.trip_tables or name not in TRIP_TABLES)
    ]
    for name in names:
        write_csv(REPORTS[name](tables), f"{folder}/{name}")
    if not options.report:
        write_map_tables(tables, f"{folder}/map")


if __name__ == "__main__":
    main()
