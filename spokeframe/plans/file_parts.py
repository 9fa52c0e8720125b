"""Clean rides and facts of trip files, kept per version of a file.

Cleaning is row by row and facts are additive, so each file is cleaned and rolled up
once. Files that a later call brings, or that were rewritten since, form a part of
their own; a table is made of the rows of all parts that belong to a present version.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, measures
from ..sources import SourceFile, append_all, headers, read_trips
from .store import new_path, small_methods

FILE = "trip_file"  #: which file a stored row came from


@dataclass(frozen=True)
class Part:
    """Where the clean rides and the facts of some files are."""

    rides: str
    facts: str


_PARTS: dict[str, dict[SourceFile, Part]] = defaultdict(dict)
_LOCK = threading.RLock()


def _made(spark: SparkSession, files: Sequence[SourceFile]) -> Part:
    part = Part(new_path(spark, "rides_of_files"), new_path(spark, "facts_of_files"))
    trips = read_trips(spark, [file.literal() for file in files], source_column=FILE)
    # Parsing and cleaning text in one step is a method several times as long as that limit.
    with small_methods(spark):
        cleaning.clean_rides(trips).write.parquet(part.rides)
    measures.rollup(spark.read.parquet(part.rides), FILE).write.parquet(part.facts)
    return part


def _present(spark: SparkSession, files: Sequence[SourceFile]) -> dict[Part, list[str]]:
    """The parts that hold these versions, each with the files to take from it."""
    with _LOCK:
        known = _PARTS[spark.sparkContext.applicationId]
        # A file without a header has no rows to keep; it is looked at again next time.
        fresh = list(headers(spark, [file for file in files if file not in known]))
        if fresh:
            part = _made(spark, fresh)
            known.update(dict.fromkeys(fresh, part))
        present: dict[Part, list[str]] = defaultdict(list)
        for file in files:
            if file in known:
                present[known[file]].append(file.uri)
        return present


def _rows(spark: SparkSession, files: Sequence[SourceFile], kind: str) -> DataFrame:
    parts = _present(spark, files)
    if not parts:
        raise ValueError("no trip files with a header")
    return append_all(
        spark.read.parquet(getattr(part, kind)).where(F.col(FILE).isin(uris)).drop(FILE)
        for part, uris in parts.items()
    )


def clean_rides(spark: SparkSession, files: Sequence[SourceFile]) -> DataFrame:
    """Clean rides of the files; only files not seen in this version before are read."""
    return _rows(spark, files, "rides")


def ride_facts(spark: SparkSession, files: Sequence[SourceFile]) -> DataFrame:
    """The rollup of the files' clean rides, from the facts of each file."""
    return measures.merged(_rows(spark, files, "facts"))
