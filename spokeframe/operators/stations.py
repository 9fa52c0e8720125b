"""Most used stations and per-station activity.

Station tables are computed in two steps: a compact rollup of the rides (one
scan, map-side combined) and a report read off it. A station may hold any share
of all rides: counts are combined before the shuffle, and distinct rides are
spread by station *and* ride id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rounding import hundredths, percent_of
from ..schema import USER_TYPES
from .keeping import Keep, as_planned

ALL_RIDERS = "all"
# The ride that stands for a station: the shortest, then the nearest; the rest of
# the key only makes the choice independent of row order.
PICK_ORDER = ("ride_length", "ride_distance", "started_at", "ride_id")


def station_column(side: str) -> str:
    if side not in ("start", "end"):
        raise ValueError(f"side must be 'start' or 'end', not {side!r}")
    return f"{side}_station_name"


def named(rides: DataFrame, side: str) -> DataFrame:
    """Rides whose station on this side has a name."""
    name = F.col(station_column(side))
    return rides.where(name.isNotNull() & (name != ""))


# Most used stations ---------------------------------------------------------


def station_counts(rides: DataFrame, side: str) -> DataFrame:
    """Rides per station, rider type and month."""
    return (
        named(rides, side)
        .groupBy(station_column(side), "member_casual", "month")
        .agg(F.count(F.lit(1)).alias("rides"))
    )


def top_stations(counts: DataFrame, side: str, n_rows: int = 10) -> DataFrame:
    """The ``n_rows`` stations with most rides; ties in name order."""
    station = station_column(side)
    totals = counts.groupBy(station).agg(F.sum("rides").alias("count"))
    return totals.orderBy(F.desc("count"), F.asc(station)).limit(n_rows)


def top_stations_by(
    counts: DataFrame,
    side: str,
    by: Sequence[str] = ("member_casual",),
    n_rows: int = 20,
    with_percent: bool = True,
) -> DataFrame:
    """Station rides split by ``by``, busiest stations first, cut at ``n_rows`` rows.

    The cut counts rows, not stations: a station that lacks one of the groups
    leaves room for a row of the next station.
    """
    station = station_column(side)
    split = counts.groupBy(station, *by).agg(F.sum("rides").alias("count"))
    total = F.sum("count").over(Window.partitionBy(station))
    table = split.withColumn("total_count", total)
    if with_percent:
        table = table.withColumn("percent_user_type", percent_of(F.col("count"), F.col("total_count")))
    return table.orderBy(F.desc("total_count"), F.asc(station), *[F.asc(c) for c in by]).limit(n_rows)


def top_n_with_ties(table: DataFrame, within: Sequence[str], weight: str, n: int) -> DataFrame:
    """Rows whose ``weight`` is among the ``n`` largest of their group, ties kept.

    Spark trims each group to its candidates before the shuffle, so a large
    group does not travel whole.
    """
    ranked = table.withColumn(
        "weight_rank", F.rank().over(Window.partitionBy(*within).orderBy(F.desc_nulls_last(weight)))
    )
    return ranked.where(F.col("weight_rank") <= n).drop("weight_rank")


def station_cardinality(counts: DataFrame, side: str) -> DataFrame:
    """Number of different station names."""
    return counts.agg(
        F.lit(side).alias("side"), F.count_distinct(station_column(side)).alias("station_names")
    )


def station_concentration(counts: DataFrame, side: str, k: int = 10) -> DataFrame:
    """Per rider type: stations used, rides, and the share of the ``k`` busiest stations."""
    station = station_column(side)
    used = counts.groupBy("member_casual", station).agg(F.sum("rides").alias("rides"))
    busiest_first = Window.partitionBy("member_casual").orderBy(F.desc("rides"), F.asc(station))
    in_top = F.when(F.col("position") <= k, F.col("rides")).otherwise(0)
    return (
        used.withColumn("position", F.row_number().over(busiest_first))
        .groupBy("member_casual")
        .agg(
            F.count(F.lit(1)).alias("stations"),
            F.sum("rides").alias("rides"),
            F.sum(in_top).alias("top_rides"),
        )
        .withColumn("top_percent", percent_of(F.col("top_rides"), F.col("rides"), 2))
    )


# Station activity, the map input --------------------------------------------


def distinct_rides(rides: DataFrame, side: str, user_types: Sequence[str] = USER_TYPES) -> DataFrame:
    """Exact distinct ride ids per station, over all riders and per rider type.

    The only heavy shuffle of the library: one row per station and ride id, with
    one flag per rider type, so the tables of all rider groups share it.
    """
    station = station_column(side)
    flags = {u: f"by_{i}" for i, u in enumerate(user_types)}
    per_ride = (
        named(rides, side)
        .groupBy(station, "ride_id")
        .agg(*[F.max(F.col("member_casual") == u).alias(flag) for u, flag in flags.items()])
    )
    per_station = per_ride.groupBy(station).agg(
        F.count(F.lit(1)).alias(ALL_RIDERS),
        *[F.count_if(F.col(flag)).alias(flag) for flag in flags.values()],
    )
    groups = [(ALL_RIDERS, ALL_RIDERS), *flags.items()]
    counted = F.explode(
        F.array(*[F.struct(F.lit(u).alias("rider_group"), F.col(c).alias("total_rides")) for u, c in groups])
    )
    return (
        per_station.select(station, counted.alias("counted"))
        .select(station, "counted.*")
        .where(F.col("total_rides") > 0)
    )


def shortest_rides(rides: DataFrame, side: str) -> DataFrame:
    """Per station and rider type, the least length and, among those, the least distance."""
    return (
        named(rides, side)
        .groupBy(station_column(side), "member_casual")
        .agg(F.min(_pick_key()).alias("pick_key"))
    )


def _pick_key() -> Column:
    """Length and distance as one number that sorts by length, then by distance.

    A plain number keeps the minimum in a hash aggregate; the minimum of a struct
    would sort all rides by station first. No two points are 2^22 hundredths of a
    kilometre apart: half the way around the Earth is less than half of that.
    """
    return hundredths(F.col("ride_length")) * 2**22 + hundredths(F.col("ride_distance"))


def representative_points(rides: DataFrame, side: str, keep: Keep = as_planned) -> DataFrame:
    """Coordinates of the ride that stands for each station, overall and per rider type."""
    return points_of(least_rides(rides, side, keep), side)


def least_rides(rides: DataFrame, side: str, keep: Keep = as_planned) -> DataFrame:
    """Per station and rider type the ride that comes first in PICK_ORDER, with its coordinates.

    Two scans: the first finds each station's least length and distance, the
    second looks at the rides that have them. ``keep`` stores the small result of
    the first, so that the join is planned by its real size.
    """
    station = station_column(side)
    shortest = keep(shortest_rides(rides, side))
    candidates = named(rides, side).withColumn("pick_key", _pick_key())
    # A missing rider type is a group of its own.
    names = {station: "of_station", "member_casual": "of_rider", "pick_key": "of_key"}
    shortest = shortest.withColumnsRenamed(names)
    is_shortest = (
        (F.col(station) == F.col("of_station"))
        & F.col("member_casual").eqNullSafe(F.col("of_rider"))
        & (F.col("pick_key") == F.col("of_key"))
    )
    candidates = candidates.join(shortest, is_shortest, "left_semi")
    ride = F.struct(*PICK_ORDER, F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lng").alias("lng"))
    return candidates.groupBy(station, "member_casual").agg(F.min(ride).alias("ride"))


def points_of(least: DataFrame, side: str) -> DataFrame:
    """Coordinates from :func:`least_rides`, of any number of parts of the rides."""
    station = station_column(side)
    overall = least.groupingSets(
        [[F.col(station), F.col("member_casual")], [F.col(station)]], station, "member_casual"
    ).agg(F.min("ride").alias("ride"), F.grouping("member_casual").alias("is_all"))
    group = F.when(F.col("is_all") == 1, ALL_RIDERS).otherwise(F.col("member_casual"))
    return overall.select(station, group.alias("rider_group"), "ride.lat", "ride.lng")


def station_activity(
    rides: DataFrame, side: str, user_types: Sequence[str] = USER_TYPES, keep: Keep = as_planned
) -> DataFrame:
    """Distinct rides and a map position per station and rider group."""
    return with_points(distinct_rides(rides, side, user_types), representative_points(rides, side, keep), side)


def with_points(counted: DataFrame, points: DataFrame, side: str) -> DataFrame:
    """Counts per station and rider group with the group's point."""
    return counted.join(points, [station_column(side), "rider_group"], "left")


def busiest(
    activity: DataFrame,
    side: str,
    rider_group: str = ALL_RIDERS,
    max_rows: int | None = None,
    min_rides: int | None = None,
    lat: str | None = None,
    lng: str | None = None,
) -> DataFrame:
    """The station table of one rider group, busiest first.

    Cut at ``max_rows`` rows, at ``min_rides`` rides, or both. ``lat`` and
    ``lng`` rename the coordinate columns.
    """
    station = station_column(side)
    table = activity.where(F.col("rider_group") == rider_group)
    if min_rides is not None:
        table = table.where(F.col("total_rides") >= min_rides)
    who = [] if rider_group == ALL_RIDERS else [F.col("rider_group").alias("member_casual")]
    table = table.select(
        station,
        *who,
        "total_rides",
        F.col("lat").alias(lat or f"{side}_lat"),
        F.col("lng").alias(lng or f"{side}_lng"),
    ).orderBy(*busiest_order(side))
    return table if max_rows is None else table.limit(max_rows)


def busiest_order(side: str) -> tuple[Column, Column]:
    return F.desc("total_rides"), F.asc(station_column(side))


# The row limits and coordinate column names of the six map tables.
MAP_TABLES: dict[str, dict] = {
    "rides_started_station": dict(side="start", max_rows=554),
    "rides_ended_station": dict(side="end", max_rows=541),
    "member_rides_started": dict(
        side="start", rider_group="member", max_rows=504, lat="startlat", lng="startlng"
    ),
    "member_rides_ended": dict(side="end", rider_group="member", max_rows=497),
    "casual_rides_started": dict(
        side="start", rider_group="casual", max_rows=470, lat="startlat", lng="startlng"
    ),
    "casual_rides_ended": dict(side="end", rider_group="casual", max_rows=459),
}
# The stated rule behind the limits: stations with more than 500 rides.
MAP_MIN_RIDES = 501
