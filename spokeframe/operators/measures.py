"""Additive ride facts, and the measures every summary table is made of.

A fact row holds a ride count and the exact sums of length and distance in
hundredths. One ride is a fact row; so is the sum of any group of rides. All
summary tables are sums over facts, so they accept either the rides themselves
or the compact :func:`rollup` of them and give the same values. Building the
rollup is one scan with map-side sums; its row count is bounded by the number
of months × weekdays × hours × bike types × rider types, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import from_hundredths, hundredths

FACT_KEYS = ("month", "day_of_week", "day_index", "hour", "rideable_type", "member_casual")
FACT_SUMS = ("rides", "length_hundredths", "distance_hundredths")


def facts(rides: DataFrame, *by: str) -> DataFrame:
    """One fact row per ride, with the columns ``by`` of the ride."""
    return rides.select(
        *by,
        "month",
        "day_of_week",
        "day_index",
        F.hour("started_at").alias("hour"),
        "rideable_type",
        "member_casual",
        F.lit(1).cast("bigint").alias("rides"),
        hundredths(F.col("ride_length")).alias("length_hundredths"),
        hundredths(F.col("ride_distance")).alias("distance_hundredths"),
    )


def rollup(rides: DataFrame, *by: str) -> DataFrame:
    """Facts summed over every combination of the keys, and of the columns ``by``."""
    return merged(facts(rides, *by), *by)


def merged(facts: DataFrame, *by: str) -> DataFrame:
    """Facts of several parts as facts of the whole."""
    return facts.groupBy(*by, *FACT_KEYS).agg(*[F.sum(c).alias(c) for c in FACT_SUMS])


def ride_count() -> Column:
    return F.sum("rides")


def total_minutes() -> Column:
    return from_hundredths(F.sum("length_hundredths"))


def total_km() -> Column:
    return from_hundredths(F.sum("distance_hundredths"))


def mean_minutes() -> Column:
    return total_minutes() / ride_count()


def mean_km() -> Column:
    return total_km() / ride_count()
