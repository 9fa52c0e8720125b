"""What a part of the rides adds to the station tables, in a form that merges.

Distinct rides can't be added up over months. Here each ride id gets a number once, and a
part's state holds, per station and rider type, the numbers of its rides as bitmaps; the
bitmaps of several parts are combined by OR and their bits counted. Rides move once, to the
task of their id, which numbers them in a range of its own and in the order of their start
stations: a station's rides share few bitmaps, and no two tasks fill parts of the same ones.
The ride that stands for a station is the least of the parts' least ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import USER_TYPES
from .keeping import Keep, as_planned
from .stations import ALL_RIDERS, least_rides, named, points_of, station_column, with_points

#: Ride numbers of one part begin at its ordinal times this; a part's tasks have 2**33 each.
PART_NUMBERS = 1 << 53
MOST_TASKS = 1 << 20


def numbered_rides(rides: DataFrame, ordinal: int, known: DataFrame | None = None, tasks: int = 8) -> DataFrame:
    """A part's rides with the numbers of their ids: ride_id, number, is_new, both stations, member_casual.

    An id that is ``known`` keeps its number; ``is_new`` marks one ride of each other id. Must be
    stored before use: numbers depend on how rows are spread. Parts need ordinals of their own,
    from 0 to 1023, that rise. A missing id is one like any other.
    """
    if not 0 <= ordinal < 1024 or not 0 < tasks < MOST_TASKS:
        raise ValueError("numbers hold 1024 parts of fewer than 2**20 tasks")
    start, end = station_column("start"), station_column("end")
    ours = rides.select("ride_id", start, end, "member_casual", F.lit(None).cast("bigint").alias("known"))
    if known is not None:
        none = [F.lit(None).cast("string").alias(c) for c in (start, end, "member_casual")]
        ours = ours.unionByName(known.select("ride_id", *none, F.col("number").alias("known")))
    # Both windows keep to the tasks that the first one's shuffle made.
    same_id = Window.partitionBy("ride_id")
    found = ours.select(
        "*", F.min("known").over(same_id).alias("given"), F.xxhash64(F.min(start).over(same_id)).alias("place")
    ).where("known IS NULL")
    in_order = found.sortWithinPartitions("place", "ride_id").withColumn("row", F.monotonically_increasing_id())
    first = F.min("row").over(Window.partitionBy("place", "ride_id"))
    return in_order.withColumn("first", first).select(
        "ride_id",
        F.coalesce("given", F.col("first") + F.lit(ordinal * PART_NUMBERS)).alias("number"),
        (F.col("given").isNull() & (F.col("row") == F.col("first"))).alias("is_new"),
        start,
        end,
        "member_casual",
    )


def new_ride_numbers(rides: DataFrame, ordinal: int, known: DataFrame | None = None, tasks: int = 8) -> DataFrame:
    """A number for each ride id of a part that is not ``known`` yet: ride_id, number.

    Must be stored before use, see :func:`numbered_rides`.
    """
    return numbers_of(numbered_rides(rides, ordinal, known, tasks))


def numbers_of(numbered: DataFrame) -> DataFrame:
    """The new ids of stored :func:`numbered_rides`, each with its number."""
    return numbered.where("is_new").select("ride_id", "number")


def ride_bitmaps(numbered: DataFrame, side: str) -> DataFrame:
    """A part's rides per station, rider type and range of numbers, as a bitmap."""
    station = station_column(side)
    return named(numbered, side).groupBy(station, "member_casual", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")
    )


def part_points(rides: DataFrame, side: str, keep: Keep = as_planned) -> DataFrame:
    """A part's least ride per station and rider type."""
    return least_rides(rides, side, keep)


def merged_activity(
    bitmaps: DataFrame, points: DataFrame, side: str, user_types: Sequence[str] = USER_TYPES
) -> DataFrame:
    """Distinct rides and a map position per station and rider group, from the states of all parts.

    Equals :func:`~.stations.station_activity` over the rides of all parts together.
    """
    station = station_column(side)
    keys = [F.col(station), F.col("member_casual"), F.col("bucket")]
    whole = bitmaps.groupingSets([keys, [keys[0], keys[2]]], *keys).agg(
        F.bitmap_or_agg("bitmap").alias("bitmap"), F.grouping("member_casual").alias("is_all")
    )
    group = F.when(F.col("is_all") == 1, ALL_RIDERS).when(F.col("member_casual").isin(*user_types), F.col("member_casual"))
    counted = (
        whole.select(station, group.alias("rider_group"), F.bitmap_count("bitmap").alias("rides"))
        .where("rider_group IS NOT NULL")
        .groupBy(station, "rider_group")
        .agg(F.sum("rides").alias("total_rides"))
    )
    return with_points(counted, points_of(points, side), side)
