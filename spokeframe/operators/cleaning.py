"""From trip records to clean rides: missing rows, derived columns, rules.

Everything here is a projection or a filter, so cleaning is one map-only pass
over the input without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar
from ..functions.geodesic import geodesic_km
from ..functions.rounding import nearest, round_half_even
from ..schema import MAINTENANCE_ENDS, MAINTENANCE_STARTS, TIME_COLUMNS

MIN_RIDE_MINUTES = 1.0
MIN_RIDE_KM = 0.0


def drop_incomplete(trips: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value; an empty string is not missing.

    For CSV input run this before :func:`parse_times`: an unreadable timestamp
    does not make a row incomplete.
    """
    present = F.lit(True)
    for name in columns or trips.columns:
        present = present & is_present(trips, name)
    return trips.where(present)


def is_present(trips: DataFrame, name: str) -> Column:
    """The value is neither NULL nor, for a number, NaN.

    One test per column, which the scan of a parquet source can apply itself.
    """
    column = F.col(name)
    if isinstance(trips.schema[name].dataType, T.DoubleType):
        return column.isNotNull() & ~F.isnan(column)
    return column.isNotNull()


def parse_times(trips: DataFrame) -> DataFrame:
    """Turn text timestamps into zone-less ones; others stay as they are."""
    text = [
        f.name for f in trips.schema.fields if f.name in TIME_COLUMNS and isinstance(f.dataType, T.StringType)
    ]
    return trips.withColumns({name: calendar.parse_timestamp(F.col(name)) for name in text})


def add_calendar(trips: DataFrame) -> DataFrame:
    """``date`` and its parts, taken from the start of the ride."""
    date = F.to_date("started_at")
    return trips.withColumns(
        {
            "date": date,
            "month": calendar.month_text(date),
            "day": calendar.day_text(date),
            "year": calendar.year_text(date),
            "day_of_week": calendar.weekday_name(date),
            "day_index": calendar.day_index(date),
        }
    )


def add_ride_length(trips: DataFrame) -> DataFrame:
    """Minutes from start to end, two decimals; can be zero or negative.

    Whole seconds never give a rounding tie: that needs 0.3 s + a multiple of 0.6 s.
    """
    seconds = calendar.seconds_between(F.col("started_at"), F.col("ended_at"))
    return trips.withColumn("ride_length", nearest(seconds / 60.0, 2))


def add_ride_distance(trips: DataFrame) -> DataFrame:
    """Geodesic kilometres between the end points, two decimals."""
    ends = ("start_lng", "start_lat", "end_lng", "end_lat")
    return trips.withColumn("ride_distance", geodesic_km(*[F.col(c) for c in ends]))


def add_ride_speed(trips: DataFrame) -> DataFrame:
    """km/h from the rounded distance and length; NULL for a zero-length ride."""
    speed = F.try_divide(F.col("ride_distance"), F.col("ride_length") / 60.0)
    return trips.withColumn("ride_speed", round_half_even(speed, 2))


DERIVED_COLUMNS = (
    "date",
    "month",
    "day",
    "year",
    "day_of_week",
    "day_index",
    "ride_length",
    "ride_distance",
    "ride_speed",
)


def derive(trips: DataFrame) -> DataFrame:
    """All derived columns, no row removed."""
    for step in (parse_times, add_calendar, add_ride_length, add_ride_distance, add_ride_speed):
        trips = step(trips)
    return trips


def long_enough() -> Column:
    """Strictly longer than a minute on the rounded length."""
    return F.col("ride_length") > MIN_RIDE_MINUTES


def went_somewhere() -> Column:
    return F.col("ride_distance") > MIN_RIDE_KM


def not_maintenance_start() -> Column:
    """The start is not a service location; a missing name counts as not listed."""
    return ~F.coalesce(F.col("start_station_name"), F.lit("")).isin(*MAINTENANCE_STARTS)


def not_maintenance_end() -> Column:
    """The end is not a service location; a missing name fails the test."""
    return ~F.col("end_station_name").isin(*MAINTENANCE_ENDS)


def clean_rides(trips: DataFrame, incomplete: Sequence[str] | None = None) -> DataFrame:
    """The cleaned ride table every report is computed from.

    ``incomplete`` lists the columns that must be present (default: all). The
    cheap rules come before the distance so that it is computed once and only
    for rides that can still qualify.
    """
    rides = add_ride_length(add_calendar(parse_times(drop_incomplete(trips, incomplete))))
    rides = rides.where(long_enough() & not_maintenance_start() & not_maintenance_end())
    return add_ride_speed(add_ride_distance(rides).where(went_somewhere()))
