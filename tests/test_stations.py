from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import by, many, rows, trip, trips
from spokeframe.operators import charts, cleaning, stations


@pytest.fixture(scope="module")
def rides_of(spark):
    return lambda *trip_rows: cleaning.clean_rides(trips(spark, *trip_rows))


def test_shortest_ride_stands_for_the_station(spark, rides_of):
    twenty_km, ten_km = 0.018, 0.009
    trip_rows = [
        trip("first in file", 1800, start_lat=41.80),
        trip("5 min 2 km", 300, start_lat=41.81, end_lat=41.81 + twenty_km),
        trip("5 min 1 km", 300, start_lat=41.82, end_lat=41.82 + ten_km),
    ]
    for _ in range(4):
        random.shuffle(trip_rows)
        for partitions in (1, 3):
            rides = rides_of(*trip_rows).repartition(partitions)
            found = rows(stations.busiest(stations.station_activity(rides, "start"), "start"))
            assert [(r["start_lat"], r["total_rides"]) for r in found] == [(41.82, 3)]


def test_distinct_rides_per_rider_group(rides_of):
    rides = rides_of(
        trip("x", 600, member_casual="member"),
        trip("x", 660, member_casual="member"),
        trip("x", 720, member_casual="casual"),
        trip("y", 600, member_casual="casual"),
        trip("z", 600, start_station_name=""),
    )
    found = by(stations.station_activity(rides, "start"), "start_station_name", "rider_group")
    assert {k: v["total_rides"] for k, v in found.items()} == {
        ("A", "all"): 2,
        ("A", "member"): 1,
        ("A", "casual"): 2,
    }


def test_station_table_cuts(rides_of):
    rides = rides_of(
        *many(3, "a", start_station_name="A"),
        *many(2, "c", start_station_name="C"),
        *many(2, "b", start_station_name="B", member_casual="casual"),
    )
    activity = stations.station_activity(rides, "start")

    def names(**options) -> list[str]:
        return [r["start_station_name"] for r in rows(stations.busiest(activity, "start", **options))]

    assert names() == ["A", "B", "C"]
    assert names(max_rows=2) == ["A", "B"]
    assert names(min_rides=3) == ["A"]
    assert names(rider_group="member") == ["A", "C"]
    assert stations.busiest(activity, "start", "casual", lat="startlat", lng="startlng").columns == [
        "start_station_name",
        "member_casual",
        "total_rides",
        "startlat",
        "startlng",
    ]


def test_limit_counts_rows_not_stations(rides_of):
    # Ten stations lead; nine of them have both rider types, one only casual riders.
    leading = []
    for i in range(9):
        name = f"S{i}"
        leading += many(3, f"m{i}-", start_station_name=name)
        leading += many(3, f"c{i}-", start_station_name=name, member_casual="casual")
    leading += many(6, "only-", start_station_name="T", member_casual="casual")
    leading += many(1, "next-", start_station_name="U")
    counts = stations.station_counts(rides_of(*leading), "start")
    found = rows(stations.top_stations_by(counts, "start"))
    assert len(found) == 20
    assert found[-1]["start_station_name"] == "U"
    assert found[18]["percent_user_type"] == 100.0
    chart = rows(charts.top_stations_by_user(counts, "start").orderBy("display_order"))
    assert chart[0]["start_station_name"] == "U"


def test_top_stations_break_ties_by_name(rides_of):
    counts = stations.station_counts(
        rides_of(*many(2, "b", end_station_name="B"), *many(2, "a", end_station_name="A"), trip("c")), "end"
    )
    found = [(r["end_station_name"], r["count"]) for r in rows(stations.top_stations(counts, "end", 2))]
    assert found == [("B", 3), ("A", 2)]


def test_top_n_with_ties(spark):
    table = spark.createDataFrame(
        [("g", "a", 5), ("g", "b", 3), ("g", "c", 3), ("g", "d", 1), ("h", "e", 1)],
        "grp string, name string, weight bigint",
    )
    found = {r["name"] for r in rows(stations.top_n_with_ties(table, ["grp"], "weight", 2))}
    assert found == {"a", "b", "c", "e"}


def test_concentration_and_cardinality(rides_of):
    counts = stations.station_counts(
        rides_of(
            *many(3, "a", start_station_name="A"),
            *many(1, "b", start_station_name="B"),
            *many(2, "c", start_station_name="C", member_casual="casual"),
        ),
        "start",
    )
    found = by(stations.station_concentration(counts, "start", k=1), "member_casual")
    assert (found["member"]["stations"], found["member"]["top_percent"]) == (2, 75.0)
    assert found["casual"]["top_percent"] == 100.0
    assert rows(stations.station_cardinality(counts, "start"))[0]["station_names"] == 3


def test_side_is_checked():
    with pytest.raises(ValueError, match="side"):
        stations.station_column("middle")


def test_a_hot_station_agrees_with_brute_force(spark):
    """A third of the rides at one station, ride ids repeated; compared with Python."""
    rng = random.Random(7)
    trip_rows = []
    for i in range(3000):
        name = "Hot" if i % 3 == 0 else f"S{rng.randrange(40)}"
        trip_rows.append(
            trip(
                f"R{rng.randrange(1200)}",
                seconds=rng.choice([120, 300, 301, 900]),
                start_station_name=name,
                start_lat=41.8 + rng.randrange(100) / 1000,
                member_casual=rng.choice(["member", "casual"]),
            )
        )
    rides = cleaning.clean_rides(trips(spark, *trip_rows)).cache()
    plain = rows(rides)
    found = by(stations.station_activity(rides, "start"), "start_station_name", "rider_group")
    expected = {}
    for group in ("all", "member", "casual"):
        for name in {r["start_station_name"] for r in plain}:
            mine = [
                r for r in plain if r["start_station_name"] == name and group in ("all", r["member_casual"])
            ]
            if mine:
                keys = (*stations.PICK_ORDER, "start_lat", "start_lng")
                pick = min(mine, key=lambda r: tuple(r[k] for k in keys))
                expected[name, group] = (len({r["ride_id"] for r in mine}), pick["start_lat"], pick["start_lng"])
    assert {k: (v["total_rides"], v["lat"], v["lng"]) for k, v in found.items()} == expected
    counted = stations.station_counts(rides, "start").agg(F.sum("rides")).first()[0]
    assert counted == len(plain)
    rides.unpersist()


def test_missing_rider_types_have_a_shortest_ride_too(spark):
    from spokeframe.operators.stations import representative_points

    table = spark.createDataFrame(
        [
            ("only", None, 20.0, 1.0, 41.1, -87.1),
            ("mixed", None, 10.0, 1.0, 41.2, -87.2),
            ("mixed", "member", 15.0, 1.0, 41.3, -87.3),
        ],
        "start_station_name string, member_casual string, ride_length double, ride_distance double, "
        "start_lat double, start_lng double",
    ).selectExpr("*", "current_timestamp() AS started_at", "'r' AS ride_id", "0D AS end_lat", "0D AS end_lng")
    points = representative_points(table, "start").where("rider_group = 'all'").collect()
    assert {r.start_station_name: r.lat for r in points} == {"only": 41.1, "mixed": 41.2}
