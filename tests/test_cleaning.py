from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from helpers import by, rows, trip, trips
from spokeframe.operators import cleaning
from spokeframe.schema import RIDE_COLUMNS, WEEKDAYS


def kept(spark, *trip_rows: dict) -> set[str]:
    return {r["ride_id"] for r in rows(cleaning.clean_rides(trips(spark, *trip_rows)))}


def test_output_columns(spark):
    assert cleaning.clean_rides(trips(spark, trip())).columns == list(RIDE_COLUMNS)


def test_blank_name_is_kept_and_missing_value_dropped(spark):
    found = kept(
        spark,
        trip("blank", start_station_name=""),
        trip("no name", end_station_name=None),
        trip("no place", end_lat=None),
        trip("nan place", end_lat=float("nan")),
    )
    assert found == {"blank"}


def test_exclusion_of_missing_names_is_asymmetric(spark):
    table = trips(spark, trip("no start", start_station_name=None), trip("no end", end_station_name=None))
    left = table.where(cleaning.not_maintenance_start() & cleaning.not_maintenance_end())
    assert [r["ride_id"] for r in rows(left)] == ["no start"]


@pytest.mark.parametrize(
    "side, name, stays",
    [
        ("start", "Charge", False),
        ("end", "Charge", True),
        ("start", "Hubbard Bike-checking (LBS-WH-TEST)", True),
        ("end", "Hubbard Bike-checking (LBS-WH-TEST)", False),
        ("start", "Base - 2132 W Hubbard", False),
        ("end", "Base - 2132 W Hubbard", True),
        ("start", "Base - 2132 W Hubbard Warehouse", False),
        ("end", "Base - 2132 W Hubbard Warehouse", False),
    ],
)
def test_maintenance_stations(spark, side, name, stays):
    assert bool(kept(spark, trip(**{f"{side}_station_name": name}))) is stays


def test_length_must_exceed_a_rounded_minute(spark):
    lengths = [59, 60, 61, 0, -30]
    table = trips(spark, *[trip(str(s), seconds=s) for s in lengths])
    found = by(cleaning.derive(table), "ride_id")
    assert {k: v["ride_length"] for k, v in found.items()} == {
        "59": 0.98,
        "60": 1.0,
        "61": 1.02,
        "0": 0.0,
        "-30": -0.5,
    }
    assert {r["ride_id"] for r in rows(cleaning.clean_rides(table))} == {"61"}


def test_distance_must_not_round_to_zero(spark):
    metre = 1 / 111_000
    table = trips(
        spark,
        trip("0m", end_lat=41.88),
        trip("4m", end_lat=41.88 + 4 * metre),
        trip("6m", end_lat=41.88 + 6 * metre),
    )
    found = by(cleaning.clean_rides(table), "ride_id")
    assert {k: v["ride_distance"] for k, v in found.items()} == {"6m": 0.01}


def test_speed_of_a_zero_length_ride_is_missing(spark):
    found = by(cleaning.derive(trips(spark, trip("zero", seconds=0), trip("ten", seconds=600))), "ride_id")
    assert found["zero"]["ride_speed"] is None
    assert found["ten"]["ride_speed"] == pytest.approx(found["ten"]["ride_distance"] * 6, abs=0.005)


def test_calendar(spark):
    days = [datetime(2022, 3, 6) + timedelta(days=i) for i in range(7)]
    table = cleaning.add_calendar(trips(spark, *[trip(str(i), start=d) for i, d in enumerate(days)]))
    found = by(table, "ride_id")
    assert [found[str(i)]["day_of_week"] for i in range(7)] == list(WEEKDAYS)
    assert [found[str(i)]["day_index"] for i in range(7)] == [1, 2, 3, 4, 5, 6, 7]
    first = found["0"]
    assert (first["month"], first["day"], first["year"]) == ("03", "06", "2022")


def test_cleaning_twice_changes_nothing(spark, sf_dir):
    from spokeframe.schema import SOURCE_COLUMNS
    from spokeframe.sources import trips_from_lineitem

    once = cleaning.clean_rides(trips_from_lineitem(spark, sf_dir))
    twice = cleaning.clean_rides(once.select(*SOURCE_COLUMNS))
    assert once.count() == twice.count() == 4966
