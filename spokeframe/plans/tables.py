"""The stored tables the reports share.

========================  =====================================================
``trips``                 trip records as delivered, out of CSV; map-only
``clean_rides``           cleaned rides; one map-only pass over the trips
``ride_facts``            additive rollup for all summaries; one scan
                          (both are kept per file where trips come from files)
``<side>_counts``         rides per station, rider type and month; one scan
``<side>_activity``       distinct rides and map position per station; one
                          shuffle of station and ride id, two scans
``station_states``        the same from mergeable states of the first eleven
                          months and of the last one, added apart
========================  =====================================================

Facts, counts and activity are bounded by the number of categories or stations,
so each report read off them costs next to nothing at any input size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import month_abbreviation
from ..operators import cleaning, measures, stations
from ..operators.keeping import Keep
from ..schema import MONTHS, TIME_COLUMNS
from ..sinks import write_csv
from ..sources import SourceFile, list_files, month_paths, read_trips, trips_from_lineitem
from . import file_parts
from .station_store import StationStates
from .store import scratch_folder, stored, written_once

LAST_MONTH = f"{len(MONTHS):02d}"


@dataclass(frozen=True)
class RideTables:
    """The shared tables of one trip source.

    ``source`` tells sources apart in the store; ``read`` gives the trip records
    and ``month_files`` the paths of the monthly CSV files. ``files`` are the files
    that trips come from, as they were when the source was named: name it again after
    a file was added or rewritten, and only that file is cleaned and rolled up.
    """

    spark: SparkSession
    source: str
    read: Callable[[], DataFrame]
    month_files: Callable[[], list[str]]
    files: tuple[SourceFile, ...] = ()

    @classmethod
    def from_csv(cls, spark: SparkSession, folder: str) -> RideTables:
        """Twelve monthly CSV files in ``folder``."""
        return cls.from_files(spark, month_paths(folder))

    @classmethod
    def from_files(cls, spark: SparkSession, paths: list[str]) -> RideTables:
        """Any CSV files or folders of files with a trip header."""
        files = tuple(list_files(spark, paths))
        versions = hashlib.sha256(repr((paths, files)).encode()).hexdigest()
        return cls(spark, versions, lambda: read_trips(spark, paths), lambda: paths, files)

    @classmethod
    def from_lineitem(cls, spark: SparkSession, sf_dir: str) -> RideTables:
        """Trips made up from the test data's ``lineitem`` table."""
        return cls(
            spark,
            sf_dir,
            lambda: trips_from_lineitem(spark, sf_dir),
            lambda: export_months(spark, sf_dir, cls.from_lineitem(spark, sf_dir).trips()),
        )

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return stored(self.spark, self.source, name, build)

    def keep(self, name: str) -> Keep:
        """Stores the intermediate table of an operator under ``name``."""
        return lambda table: self.stored(f"{name}-{table.semanticHash() & 0xFFFFFFFF:08x}", lambda: table)

    def trips(self) -> DataFrame:
        """The trip records; stored, as checks and profiles scan them many times.

        Left as a view, parsing (or, for the test data, the arithmetic that makes
        the trips up) would be repeated in every scan and copied into its filters.
        """
        return self.stored("trips", self.read)

    def rides(self) -> DataFrame:
        if self._by_file():
            return file_parts.clean_rides(self.spark, self.files)
        return self.stored("clean_rides", lambda: cleaning.clean_rides(self.trips()))

    def _by_file(self) -> bool:
        return bool(self.files) and scratch_folder(self.spark) is not None

    def facts(self) -> DataFrame:
        if self._by_file():
            return self.stored("ride_facts", lambda: file_parts.ride_facts(self.spark, self.files))
        return self.stored("ride_facts", lambda: measures.rollup(self.rides()))

    def counts(self, side: str) -> DataFrame:
        return self.stored(f"{side}_counts", lambda: stations.station_counts(self.rides(), side))

    def activity(self, side: str) -> DataFrame:
        return self.stored(
            f"{side}_activity",
            lambda: stations.station_activity(self.rides(), side, keep=self.keep(f"{side}_shortest")),
        )

    def merged_activity(self, side: str) -> DataFrame:
        """As :meth:`activity`, from states that were added part by part."""
        path, _ = written_once(self.spark, self.source, "station_states", self._add_states)
        return StationStates(self.spark, path).activity(side)

    def _add_states(self, path: str) -> None:
        states, rides = StationStates(self.spark, path), self.rides()
        last = F.col("month").eqNullSafe(LAST_MONTH)
        states.add("first", rides.where(~last), keep=self.keep("first_shortest"))
        states.add("last", rides.where(last), keep=self.keep("last_shortest"))

    def csv_round_trip(
        self, name: str, table: DataFrame, write: Callable[[DataFrame, str], None] = write_csv
    ) -> DataFrame:
        """Write a report as CSV and read it back in the report's types."""
        path, _ = written_once(self.spark, self.source, f"csv_{name}", lambda p: write(table, p))
        back = self.spark.read.option("header", True).option("escape", '"').csv(path)
        types = {f.name: f.dataType for f in table.schema.fields}
        return back.select(*[F.col(c).cast(types.get(c, "bigint")) for c in back.columns])


def export_months(spark: SparkSession, source: str, trips: DataFrame) -> list[str]:
    """Write trips as CSV, one folder of files per month, and return the folders."""

    def write(path: str) -> None:
        # Even files of a useful size, however the months are spread over the input; times move as numbers.
        months = trips.withColumn("month_file", month_abbreviation(F.month("started_at")))
        even = months.hint("rebalance", F.col("month_file"))
        text = even.withColumns({c: F.col(c).cast("string") for c in TIME_COLUMNS})
        text.write.partitionBy("month_file").option("header", True).option("escape", '"').csv(path)

    path, _ = written_once(spark, source, "monthly_csv", write)
    return [f"{path}/month_file={month}" for month in MONTHS]
