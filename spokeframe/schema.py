"""Column layout and fixed values of the trip records."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# Column names, rider and bike types and station names as they occur in the
# trip files; results are only right when they are spelled exactly like this.

TEXT_COLUMNS = (
    "ride_id",
    "rideable_type",
    "start_station_name",
    "end_station_name",
    "member_casual",
)
TIME_COLUMNS = ("started_at", "ended_at")
COORDINATE_COLUMNS = ("start_lat", "start_lng", "end_lat", "end_lng")

SOURCE_COLUMNS = (
    "ride_id",
    "rideable_type",
    "started_at",
    "ended_at",
    "start_station_name",
    "end_station_name",
    "start_lat",
    "start_lng",
    "end_lat",
    "end_lng",
    "member_casual",
)

USER_TYPES = ("casual", "member")
BIKE_TYPES = ("classic_bike", "electric_bike", "docked_bike")

MAINTENANCE_STARTS = (
    "Base - 2132 W Hubbard Warehouse",
    "Base - 2132 W Hubbard",
    "Charge",
)
MAINTENANCE_ENDS = (
    "Hubbard Bike-checking (LBS-WH-TEST)",
    "Base - 2132 W Hubbard Warehouse",
)

WEEKDAYS = (
    "Sunday",
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
)
MONTHS = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun",
    "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)
# --- End of fixed values ----------------------------------------------------

TRIPS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("ride_id", "rideable_type")]
    + [T.StructField(c, T.TimestampNTZType()) for c in TIME_COLUMNS]
    + [T.StructField(c, T.StringType()) for c in ("start_station_name", "end_station_name")]
    + [T.StructField(c, T.DoubleType()) for c in COORDINATE_COLUMNS]
    + [T.StructField("member_casual", T.StringType())]
)

CALENDAR_COLUMNS = ("date", "month", "day", "year", "day_of_week", "day_index")
MEASURE_COLUMNS = ("ride_length", "ride_distance", "ride_speed")
RIDE_COLUMNS = SOURCE_COLUMNS + CALENDAR_COLUMNS + MEASURE_COLUMNS
