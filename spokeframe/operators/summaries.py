"""Ride summaries by rider type, month, weekday, hour and bike type.

Each function takes ride facts (see :mod:`.measures`), per ride or rolled up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import level_rank
from ..functions.rounding import percent_of
from ..schema import BIKE_TYPES, USER_TYPES
from .measures import mean_km, mean_minutes, ride_count, total_km, total_minutes

WEEKDAY = ("day_of_week", "day_index")


def summarise(facts: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    """Group by ``keys`` and compute the named measures."""
    return facts.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()])


def with_share(
    table: DataFrame,
    count: str,
    within: Sequence[str],
    name: str,
    digits: int = 0,
    only: Column | None = None,
) -> DataFrame:
    """Add ``count`` as a percentage of its total over the rows equal in ``within``.

    Meant for summary tables: the window runs over already grouped rows. Rows
    where ``only`` does not hold count towards the total but get NULL.
    """
    share = percent_of(F.col(count), F.sum(count).over(Window.partitionBy(*within)), digits)
    return table.withColumn(name, share if only is None else F.when(only, share))


def known_user() -> Column:
    return F.col("member_casual").isin(*USER_TYPES)


# Rider types ----------------------------------------------------------------


def rides_summary(facts: DataFrame) -> DataFrame:
    """Rides per rider type and a ``Total`` row; a missing type reads ``Total`` too."""
    counted = facts.rollup("member_casual").agg(
        ride_count().alias("total_rides"), F.grouping("member_casual").alias("is_total")
    )
    name = F.col("member_casual")
    label = F.when((F.col("is_total") == 1) | name.isNull(), "Total").otherwise(name)
    return counted.select(label.alias("member_casual"), "total_rides")


def user_rides(facts: DataFrame) -> DataFrame:
    counted = summarise(facts, ["member_casual"], total_rides=ride_count())
    return with_share(counted, "total_rides", [], "percent", digits=2)


def user_type_average(facts: DataFrame) -> DataFrame:
    return summarise(facts, ["member_casual"], average_ride_time=mean_minutes(), average_distance=mean_km())


# Months ---------------------------------------------------------------------


def total_monthly_rides(facts: DataFrame) -> DataFrame:
    return summarise(facts, ["month"], rides=ride_count())


def user_type_monthly_calc(facts: DataFrame) -> DataFrame:
    return summarise(
        facts,
        ["month", "member_casual"],
        number_of_rides=ride_count(),
        total_ride_time=total_minutes(),
        average_ride_time=mean_minutes(),
        average_ride_distance=mean_km(),
    )


def user_type_monthly_data(facts: DataFrame) -> DataFrame:
    counted = summarise(facts, ["member_casual", "month"], number_of_rides=ride_count())
    return with_share(counted, "number_of_rides", ["month"], "percentage", only=known_user())


def average_monthly_distance_user(facts: DataFrame) -> DataFrame:
    return summarise(facts, ["month", "member_casual"], average_distance=mean_km())


def month_breaks(facts: DataFrame, count: int = 12) -> DataFrame:
    """``count`` evenly spaced values from the first to the last month present."""
    month = F.col("month").cast("int")
    ends = facts.agg(F.min(month).alias("first"), F.max(month).alias("last"))
    step = (F.col("last") - F.col("first")) / float(count - 1)
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("position"), "first", "last").select(
        "position", (F.col("first") + F.col("position") * step).alias("month_break")
    )


# Weekdays -------------------------------------------------------------------


def total_daily_rides(facts: DataFrame) -> DataFrame:
    counted = summarise(facts, ["member_casual", *WEEKDAY], number_of_rides=ride_count())
    return with_share(counted, "number_of_rides", ["day_of_week"], "percent")


def daily_rides_user_type(facts: DataFrame) -> DataFrame:
    return summarise(
        facts,
        ["member_casual", *WEEKDAY],
        number_of_rides=ride_count(),
        total_ride_time=total_minutes(),
        average_ride_time=mean_minutes(),
        average_distance=mean_km(),
    )


def average_daily_distance_user(facts: DataFrame) -> DataFrame:
    return summarise(facts, [*WEEKDAY, "member_casual"], average_distance=mean_km())


# Bike types -----------------------------------------------------------------


def total_rideable_type(facts: DataFrame) -> DataFrame:
    return summarise(
        facts,
        ["rideable_type"],
        number_of_rides=ride_count(),
        total_ride_length=total_minutes(),
        average_ride_length=mean_minutes(),
        total_distance=total_km(),
        average_distance=mean_km(),
    )


def user_type_ride_total(facts: DataFrame) -> DataFrame:
    return summarise(facts, ["rideable_type", "member_casual"], number_of_rides=ride_count())


def user_type_ride_type(facts: DataFrame) -> DataFrame:
    """Rides and times per bike and rider type; the share is within the bike type."""
    counted = summarise(
        facts,
        ["rideable_type", "member_casual"],
        number_of_rides=ride_count(),
        total_ride_time=total_minutes(),
        average_ride_time=mean_minutes(),
    )
    shared = with_share(counted, "number_of_rides", ["rideable_type"], "percentage", only=known_user())
    return shared.withColumn("type_rank", level_rank(F.col("rideable_type"), BIKE_TYPES).cast("int"))


def bike_type_by_user(facts: DataFrame) -> DataFrame:
    """Share of each bike type within the rides of a rider type."""
    counted = user_type_ride_total(facts)
    return with_share(counted, "number_of_rides", ["member_casual"], "percent_of_user")


def user_ride_type_monthly(facts: DataFrame) -> DataFrame:
    return summarise(
        facts,
        ["rideable_type", "member_casual", "month"],
        number_of_rides=ride_count(),
        total_ride_time=total_minutes(),
        average_ride_time=mean_minutes(),
    )


def user_ride_type_day(facts: DataFrame) -> DataFrame:
    return summarise(
        facts,
        ["rideable_type", "member_casual", *WEEKDAY],
        number_of_rides=ride_count(),
        total_ride_time=total_minutes(),
        average_ride_time=mean_minutes(),
    )


# Hours ----------------------------------------------------------------------


def rides_by_hour(facts: DataFrame) -> DataFrame:
    return summarise(facts.where(F.col("hour").isNotNull()), ["hour"], count=ride_count())


def rides_by_hour_user_type(facts: DataFrame) -> DataFrame:
    return summarise(facts.where(F.col("hour").isNotNull()), ["hour", "member_casual"], count=ride_count())
