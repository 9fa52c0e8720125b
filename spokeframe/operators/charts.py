"""The table behind each chart: labels, category order, display positions.

Drawing is left to the reader's plotting tool; these are its inputs. All are
report-sized tables built from the summary and station tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import month_abbreviation
from ..functions.labels import legend_label, level_rank, percent_label, short_count, spaced, thousands
from ..functions.rounding import percent_of
from ..schema import BIKE_TYPES, USER_TYPES
from . import stations, summaries
from .stations import station_column


def _display_order(*keys: Column) -> Column:
    """Position on the axis; the table is report sized by now."""
    return F.dense_rank().over(Window.orderBy(*keys))


def _with_month(table: DataFrame) -> DataFrame:
    number = F.col("month").cast("int")
    return table.withColumns({"month_number": number, "month_label": month_abbreviation(number)})


def top_stations(counts: DataFrame, side: str, n_rows: int = 10) -> DataFrame:
    """Busiest stations, the axis growing with the count."""
    name = F.col(station_column(side))
    return stations.top_stations(counts, side, n_rows).select(
        name,
        "count",
        _display_order(F.asc("count"), name.asc()).alias("display_order"),
        thousands(F.col("count")).alias("count_label"),
    )


def top_stations_by_user(counts: DataFrame, side: str, n_rows: int = 20) -> DataFrame:
    """Busiest stations split by rider type, with share labels."""
    name = F.col(station_column(side))
    return stations.top_stations_by(counts, side, n_rows=n_rows).select(
        name,
        "member_casual",
        "count",
        "total_count",
        "percent_user_type",
        _display_order(F.asc("total_count"), name.asc()).alias("display_order"),
        percent_label(F.col("percent_user_type")).alias("percent_label"),
    )


def user_share(facts: DataFrame) -> DataFrame:
    """Rides per rider type with slice and legend labels."""
    rides = F.col("total_rides")
    share = percent_of(rides, F.sum("total_rides").over(Window.partitionBy()))
    return summaries.user_rides(facts).select(
        "member_casual",
        "total_rides",
        "percent",
        percent_label(share).alias("slice_label"),
        legend_label(F.col("member_casual"), rides).alias("legend_label"),
    )


def user_type_totals(facts: DataFrame) -> DataFrame:
    """One row with the rides of each known rider type and its legend text."""
    totals = facts.agg(
        *[F.sum(F.when(F.col("member_casual") == u, F.col("rides"))).alias(f"{u}_rides") for u in USER_TYPES]
    )
    return totals.select(
        "*",
        *[legend_label(F.lit(u), F.col(f"{u}_rides")).alias(f"{u}_label") for u in USER_TYPES],
    )


def bike_type_share(facts: DataFrame) -> DataFrame:
    """Totals of the three known bike types under their display names."""
    known = summaries.total_rideable_type(facts.where(F.col("rideable_type").isin(*BIKE_TYPES)))
    return known.withColumns(
        {
            "rideable_type": spaced(F.col("rideable_type")),
            "count_label": thousands(F.col("number_of_rides")),
        }
    )


def user_bike_rides(facts: DataFrame) -> DataFrame:
    """Rides by rider and bike type, stacked."""
    return summaries.user_type_ride_total(facts).withColumns(
        {
            "bike_label": spaced(F.col("rideable_type")),
            "count_label": short_count(F.col("number_of_rides")),
        }
    )


def bike_type_by_user(facts: DataFrame) -> DataFrame:
    """Slices of each rider type's rides by bike type, in the fixed bike order."""
    return summaries.bike_type_by_user(facts).select(
        "member_casual",
        "rideable_type",
        level_rank(F.col("rideable_type"), BIKE_TYPES).cast("int").alias("type_rank"),
        "number_of_rides",
        "percent_of_user",
        thousands(F.col("number_of_rides")).alias("count_label"),
    )


def monthly_rides(facts: DataFrame) -> DataFrame:
    """Rides per month, on a numeric month axis."""
    monthly = summaries.total_monthly_rides(facts)
    return _with_month(monthly).select(
        F.col("month_number").alias("month"),
        "month_label",
        "rides",
        short_count(F.col("rides")).alias("rides_label"),
    )


def monthly_user(facts: DataFrame) -> DataFrame:
    """Monthly rides by rider type with share labels."""
    table = _with_month(summaries.user_type_monthly_data(facts))
    return table.withColumn("percent_label", percent_label(F.col("percentage")))


def daily_user(facts: DataFrame) -> DataFrame:
    """Weekday rides by rider type with share labels."""
    table = summaries.total_daily_rides(facts)
    return table.withColumn("percent_label", percent_label(F.col("percent")))


def hourly(facts: DataFrame) -> DataFrame:
    table = summaries.rides_by_hour(facts)
    return table.withColumn("count_label", short_count(F.col("count")))


def hourly_user(facts: DataFrame) -> DataFrame:
    table = summaries.rides_by_hour_user_type(facts)
    return table.withColumn("count_label", short_count(F.col("count")))


def monthly_ride_time(facts: DataFrame) -> DataFrame:
    """Average minutes per month and rider type."""
    table = _with_month(summaries.user_type_monthly_calc(facts))
    return table.select("month", "month_number", "month_label", "member_casual", "average_ride_time")


def daily_ride_time(facts: DataFrame) -> DataFrame:
    """Average minutes per weekday and rider type."""
    table = summaries.daily_rides_user_type(facts)
    return table.select("day_of_week", "day_index", "member_casual", "average_ride_time")


def monthly_distance(facts: DataFrame) -> DataFrame:
    """Average kilometres per month and rider type."""
    return _with_month(summaries.average_monthly_distance_user(facts))


def daily_distance(facts: DataFrame) -> DataFrame:
    """Average kilometres per weekday and rider type, in weekday order."""
    return summaries.average_daily_distance_user(facts)


def label_counts(facts: DataFrame) -> DataFrame:
    """Both count labels for the rides of every bike type, rider type and weekday."""
    table = summaries.user_ride_type_day(facts)
    count = F.col("number_of_rides")
    return table.select(
        "rideable_type",
        "member_casual",
        "day_of_week",
        "number_of_rides",
        short_count(count).alias("short_label"),
        thousands(count).alias("comma_label"),
    )
