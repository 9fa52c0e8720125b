"""Every report by name, over the shared tables of a trip source."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import parse_timestamp
from ..operators import charts, cleaning, profile, stations, summaries
from ..schema import RIDE_COLUMNS, SOURCE_COLUMNS, TIME_COLUMNS
from ..sinks import write_csv, write_ranked_csv
from ..sources import append_all, month_of_path, read_trips
from .store import written_once
from .tables import RideTables

Report = Callable[[RideTables], DataFrame]

IDENTITY = ("ride_id", "started_at", "ended_at")
INSPECT_ROWS = 6
# The last two are no timestamps here: the day comes first, or separators are mixed.
TIMESTAMP_FORMS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/M/d H:m:s",
    "yyyy.MM.dd HH.mm.ss",
    "yyyyMMdd'T'HHmmss'Z'",
    "dd/MM/yyyy HH:mm:ss",
    "yyyy/MM-dd HH:mm:ss",
)
# Limits that bind on the test data, which has fewer stations than the map limits.
SHORT_MAP_ROWS = 25


# Rows -----------------------------------------------------------------------


def trips_by_month_file(tables: RideTables) -> DataFrame:
    rows = read_trips(tables.spark, tables.month_files(), source_column="source_path")
    return rows.groupBy(month_of_path(F.col("source_path")).alias("month_file")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def trips_union_all(tables: RideTables) -> DataFrame:
    # Months of one layout are one scan; others are appended by column name.
    everything = read_trips(tables.spark, tables.month_files())
    return cleaning.parse_times(everything).select(*SOURCE_COLUMNS)


def _complete(tables: RideTables) -> DataFrame:
    return cleaning.drop_incomplete(tables.trips())


def trips_drop_na(tables: RideTables) -> DataFrame:
    return _complete(tables).select(*SOURCE_COLUMNS)


def missing_value_rule(tables: RideTables) -> DataFrame:
    """What is missing or blank in trips written as CSV with ``NA``, blank and quoted blank fields."""
    day = F.dayofmonth("started_at")
    latitude = F.col("end_lat").cast("string")
    marked = tables.trips().withColumns(
        {
            # NULL is written as a blank, an empty text as a quoted blank.
            "start_station_name": F.when(day % 4 == 0, "NA")
            .when(day % 4 == 1, "")
            .when(day % 4 == 3, F.col("start_station_name")),
            "end_lat": F.when(day % 5 == 0, "NA").when(day % 5 == 1, "").otherwise(latitude),
            **{c: F.col(c).cast("string") for c in TIME_COLUMNS},
        }
    )
    path, _ = written_once(tables.spark, tables.source, "marked_csv", lambda p: write_csv(marked, p))
    back = read_trips(tables.spark, [path])
    complete = reduce(and_, [cleaning.is_present(back, c) for c in SOURCE_COLUMNS])
    name = F.col("start_station_name")
    return back.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(name.isNull()).alias("missing_names"),
        F.count_if(name == "").alias("blank_names"),
        F.count_if(F.col("end_lat").isNull()).alias("missing_latitudes"),
        F.count_if(complete).alias("complete_rows"),
    )


def appended_months(tables: RideTables) -> DataFrame:
    """The monthly table after the last month's files were added to those of the others."""
    months = tables.month_files()
    RideTables.from_files(tables.spark, months[:-1]).facts()
    return summaries.user_type_monthly_calc(RideTables.from_files(tables.spark, months).facts())


def timestamp_forms(tables: RideTables) -> DataFrame:
    """Trip starts written in several forms, and how many of each are read back as they were."""
    start = F.col("started_at")
    form = F.dayofmonth(start) % len(TIMESTAMP_FORMS)
    text = F.element_at(F.array(*[F.date_format(start, p) for p in TIMESTAMP_FORMS]), form + 1)
    written = tables.trips().where(start.isNotNull()).select(form.alias("form"), start, text.alias("text"))
    back = written.withColumn("back", parse_timestamp(F.col("text")))
    return back.groupBy("form").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("back").eqNullSafe(start)).alias("read"),
        F.count_if(F.col("back").isNull()).alias("rejected"),
    )


def trips_calendar(tables: RideTables) -> DataFrame:
    text = cleaning.drop_incomplete(read_trips(tables.spark, tables.month_files()))
    dated = cleaning.add_calendar(cleaning.parse_times(text))
    return dated.select(*IDENTITY, "date", "month", "day", "year", "day_of_week", "day_index")


def trips_ride_length(tables: RideTables) -> DataFrame:
    return cleaning.add_ride_length(cleaning.parse_times(_complete(tables))).select(*IDENTITY, "ride_length")


def trips_ride_distance(tables: RideTables) -> DataFrame:
    measured = cleaning.add_ride_distance(_complete(tables))
    return measured.select(*IDENTITY, "start_lat", "start_lng", "end_lat", "end_lng", "ride_distance")


def trips_ride_speed(tables: RideTables) -> DataFrame:
    return cleaning.derive(_complete(tables)).select(
        *IDENTITY, "ride_length", "ride_distance", "ride_speed"
    )


def clean_rides(tables: RideTables) -> DataFrame:
    return tables.rides().select(*RIDE_COLUMNS)


def inspect_shortest(tables: RideTables) -> DataFrame:
    columns = ("ride_length", "ride_distance", "started_at", "ride_id")
    return (
        cleaning.derive(_complete(tables))
        .select(*columns)
        .orderBy(*[F.asc_nulls_last(c) for c in columns])
        .limit(INSPECT_ROWS)
    )


# Families of reports --------------------------------------------------------


def _from_facts(report: Callable[[DataFrame], DataFrame]) -> Report:
    return lambda tables: report(tables.facts())


def _from_counts(side: str, report: Callable[..., DataFrame], **options) -> Report:
    return lambda tables: report(tables.counts(side), side, **options)


def _map_table(side: str, **options) -> Report:
    return lambda tables: stations.busiest(tables.activity(side), side, **options)


def _merged_map_table(side: str, **options) -> Report:
    return lambda tables: stations.busiest(tables.merged_activity(side), side, **options)


def _map_table_csv(name: str) -> Report:
    options = stations.MAP_TABLES[name]

    def report(tables: RideTables) -> DataFrame:
        table = _map_table(**options)(tables)
        order = stations.busiest_order(options["side"])
        return tables.csv_round_trip(name, table, lambda t, path: write_ranked_csv(t, path, order, options["max_rows"]))

    return report


def station_cardinality(tables: RideTables) -> DataFrame:
    return append_all(
        stations.station_cardinality(tables.counts(side), side) for side in ("start", "end")
    )


def top_n_with_ties(tables: RideTables) -> DataFrame:
    """The three busiest start stations of every month, ties kept."""
    monthly = (
        tables.counts("start")
        .groupBy("month", "start_station_name")
        .agg(F.sum("rides").alias("count"))
    )
    return stations.top_n_with_ties(monthly, ["month"], "count", 3)


# Profiles and checks --------------------------------------------------------


def profile_numeric(tables: RideTables) -> DataFrame:
    return profile.profile_numeric(tables.trips(), keep=tables.keep("trip_quartiles"))


def profile_rides(tables: RideTables) -> DataFrame:
    return profile.profile_numeric(tables.rides(), keep=tables.keep("ride_quartiles"))


def profile_dates(tables: RideTables) -> DataFrame:
    return profile.profile_dates(cleaning.add_calendar(cleaning.parse_times(_complete(tables))))


def profile_text(tables: RideTables) -> DataFrame:
    return profile.profile_text(tables.trips())


def profile_shape(tables: RideTables) -> DataFrame:
    return profile.profile_shape(tables.trips())


def cleaning_audit(tables: RideTables) -> DataFrame:
    return profile.cleaning_audit(tables.trips())


def has_duplicate_rows(tables: RideTables) -> DataFrame:
    keep = tables.keep("repeated_hashes")
    return profile.has_duplicate_trips(_complete(tables), keep)


def station_duplicates(tables: RideTables) -> DataFrame:
    return profile.has_duplicate_rows(_map_table(**stations.MAP_TABLES["rides_started_station"])(tables))


REPORTS: dict[str, Report] = {
    # Sources, cleaning, derived columns
    "trips_by_month_file": trips_by_month_file,
    "trips_union_all": trips_union_all,
    "missing_value_rule": missing_value_rule,
    "trips_drop_na": trips_drop_na,
    "appended_months": appended_months,
    "timestamp_forms": timestamp_forms,
    "trips_calendar": trips_calendar,
    "trips_ride_length": trips_ride_length,
    "trips_ride_distance": trips_ride_distance,
    "trips_ride_speed": trips_ride_speed,
    "clean_rides": clean_rides,
    "inspect_shortest": inspect_shortest,
    # Summaries
    "rides_summary": _from_facts(summaries.rides_summary),
    "user_rides": _from_facts(summaries.user_rides),
    "user_type_average": _from_facts(summaries.user_type_average),
    "total_monthly_rides": _from_facts(summaries.total_monthly_rides),
    "user_type_monthly_calc": _from_facts(summaries.user_type_monthly_calc),
    "user_type_monthly_data": _from_facts(summaries.user_type_monthly_data),
    "average_monthly_distance_user": _from_facts(summaries.average_monthly_distance_user),
    "month_breaks": _from_facts(summaries.month_breaks),
    "total_daily_rides": _from_facts(summaries.total_daily_rides),
    "daily_rides_user_type": _from_facts(summaries.daily_rides_user_type),
    "average_daily_distance_user": _from_facts(summaries.average_daily_distance_user),
    "total_rideable_type": _from_facts(summaries.total_rideable_type),
    "user_type_ride_total": _from_facts(summaries.user_type_ride_total),
    "user_type_ride_type": _from_facts(summaries.user_type_ride_type),
    "user_ride_type_monthly": _from_facts(summaries.user_ride_type_monthly),
    "user_ride_type_day": _from_facts(summaries.user_ride_type_day),
    "rides_by_hour": _from_facts(summaries.rides_by_hour),
    "rides_by_hour_user_type": _from_facts(summaries.rides_by_hour_user_type),
    # Most used stations
    "top_start_station": _from_counts("start", stations.top_stations),
    "top_station_user_type": _from_counts("start", stations.top_stations_by),
    "top_station_user_type_mo": _from_counts(
        "start", stations.top_stations_by, by=("member_casual", "month"), n_rows=240, with_percent=False
    ),
    "top_end_station": _from_counts("end", stations.top_stations),
    "top_end_station_user_type": _from_counts("end", stations.top_stations_by),
    "top_end_station_user_type_mo": _from_counts(
        "end", stations.top_stations_by, by=("member_casual", "month"), n_rows=240, with_percent=False
    ),
    "top_n_with_ties": top_n_with_ties,
    "station_cardinality": station_cardinality,
    "station_concentration": _from_counts("start", stations.station_concentration),
    "end_station_concentration": _from_counts("end", stations.station_concentration),
    # Station tables for the map, with the fixed limits, a binding limit and the stated rule
    **{name: _map_table(**options) for name, options in stations.MAP_TABLES.items()},
    **{
        f"{name}_short": _map_table(**{**options, "max_rows": SHORT_MAP_ROWS})
        for name, options in stations.MAP_TABLES.items()
    },
    **{
        f"{name}_over_500": _map_table(**{**options, "max_rows": None, "min_rides": stations.MAP_MIN_RIDES})
        for name, options in stations.MAP_TABLES.items()
    },
    **{f"merged_{name}": _merged_map_table(**options) for name, options in stations.MAP_TABLES.items()},
    **{f"sink_{name}": _map_table_csv(name) for name in stations.MAP_TABLES},
    # Profiles and checks
    "profile_numeric": profile_numeric,
    "profile_rides": profile_rides,
    "profile_dates": profile_dates,
    "profile_text": profile_text,
    "profile_shape": profile_shape,
    "cleaning_audit": cleaning_audit,
    "has_duplicate_rows": has_duplicate_rows,
    "station_duplicates": station_duplicates,
    # Tables behind the charts
    "chart_top_start": _from_counts("start", charts.top_stations),
    "chart_top_end": _from_counts("end", charts.top_stations),
    "chart_top_start_user": _from_counts("start", charts.top_stations_by_user),
    "chart_top_end_user": _from_counts("end", charts.top_stations_by_user),
    "chart_user_share": _from_facts(charts.user_share),
    "user_type_totals": _from_facts(charts.user_type_totals),
    "bike_type_share": _from_facts(charts.bike_type_share),
    "chart_user_bike": _from_facts(charts.user_bike_rides),
    "bike_type_by_user": _from_facts(charts.bike_type_by_user),
    "monthly_rides": _from_facts(charts.monthly_rides),
    "chart_monthly_user": _from_facts(charts.monthly_user),
    "chart_daily_user": _from_facts(charts.daily_user),
    "chart_hourly": _from_facts(charts.hourly),
    "chart_hourly_user": _from_facts(charts.hourly_user),
    "chart_monthly_ride_time": _from_facts(charts.monthly_ride_time),
    "chart_daily_ride_time": _from_facts(charts.daily_ride_time),
    "chart_monthly_distance": _from_facts(charts.monthly_distance),
    "chart_daily_distance": _from_facts(charts.daily_distance),
    "label_counts": _from_facts(charts.label_counts),
}


def _over_lineitem(report: Report) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report(RideTables.from_lineitem(spark, sf_dir))


# The same reports over the trips made up from the test data, by (spark, folder).
QUERIES = {name: _over_lineitem(report) for name, report in REPORTS.items()}


def write_map_tables(tables: RideTables, folder: str) -> None:
    """Write the six station tables as CSV for a mapping tool."""
    for name, options in stations.MAP_TABLES.items():
        table = _map_table(**options)(tables)
        order = stations.busiest_order(options["side"])
        write_ranked_csv(table, f"{folder.rstrip('/')}/{name}", order, options["max_rows"])
