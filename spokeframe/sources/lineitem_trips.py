"""Trip records derived from the ``lineitem`` table of the test data.

The test data holds no trips, so each line item is read as one: order, part and
supplier keys choose the stations, the price the time of day, the duration and
the exact coordinates. Integer arithmetic only, so any engine gets equal rows;
see FIXTURES.md for the definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SOURCE_COLUMNS

LINEITEM_COLUMNS = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_extendedprice",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)

# --- Fixed values: station indexes that stand for a special name ---
START_NAMES = {
    7: "",
    11: "Base - 2132 W Hubbard Warehouse",
    13: "Charge",
    17: "Base - 2132 W Hubbard",
}
END_NAMES = {
    7: "",
    11: "Base - 2132 W Hubbard Warehouse",
    13: "Charge",
    19: "Hubbard Bike-checking (LBS-WH-TEST)",
}


STATIONS = 60
# --- End of fixed values ---


def _station_name(index: Column, special: dict[int, str]) -> Column:
    names = [special.get(i, f"Station {i}") for i in range(STATIONS)]
    return F.get(F.array(*[F.lit(name) for name in names]), index.cast("int"))


def _plus_seconds(moment: Column, seconds: Column) -> Column:
    return moment + F.expr("INTERVAL '1' SECOND") * seconds


def trips_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, part, supplier, line = (
        F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    )
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINEITEM_COLUMNS)
    helpers = items.select("*", F.rint(F.col("l_extendedprice") * 100.0).cast("bigint").alias("cents"))
    cents = F.col("cents")
    duration = (
        F.when(cents % 97 == 0, F.lit(60)).when(cents % 89 == 0, F.lit(0)).otherwise(cents % 5400 - 30)
    )
    helpers = helpers.select(
        "*",
        F.least(order % STATIONS, (supplier * 7 + line) % STATIONS).alias("start_index"),
        F.least(part % STATIONS, (order * 3 + line) % STATIONS).alias("end_index"),
        ((cents * 31 + order * 7 + line) % 86400).alias("start_second"),
        duration.alias("duration"),
    )
    start, end = F.col("start_index"), F.col("end_index")
    second = F.col("start_second")
    bike = (
        F.when(F.col("l_returnflag") == "N", "electric_bike")
        .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "docked_bike")
        .otherwise("classic_bike")
    )

    def latitude(index: Column, spread: int) -> Column:
        return (4164000 + index * 700 + cents % spread) / F.lit(1e5)

    def longitude(index: Column, spread: int) -> Column:
        return (-8785000 + (index * 1300) % 33000 + cents % spread) / F.lit(1e5)

    start_lat, start_lng = latitude(start, 100), longitude(start, 50)

    def arrival(same_as: Column, elsewhere: Column) -> Column:
        return F.when(part % 211 == 0, F.lit(None)).when(cents % 53 == 0, same_as).otherwise(elsewhere)

    return helpers.select(
        F.concat(F.lit("R"), order.cast("string"), F.lit("-"), line.cast("string")).alias("ride_id"),
        bike.alias("rideable_type"),
        _plus_seconds(F.col("l_shipdate"), second).alias("started_at"),
        _plus_seconds(F.col("l_shipdate"), second + F.col("duration")).alias("ended_at"),
        _station_name(start, START_NAMES).alias("start_station_name"),
        _station_name(end, END_NAMES).alias("end_station_name"),
        start_lat.alias("start_lat"),
        start_lng.alias("start_lng"),
        arrival(start_lat, latitude(end, 70)).alias("end_lat"),
        arrival(start_lng, longitude(end, 40)).alias("end_lng"),
        F.when(F.col("l_linestatus") == "F", "casual").otherwise("member").alias("member_casual"),
    ).select(*SOURCE_COLUMNS)
