"""Small literal trips for the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from spokeframe.schema import SOURCE_COLUMNS, TRIPS

T0 = datetime(2022, 3, 7, 8, 0, 0)  # a Monday


def trip(ride_id: str = "R1", seconds: float = 600, start: datetime = T0, **values) -> dict:
    row = {
        "ride_id": ride_id,
        "rideable_type": "classic_bike",
        "started_at": start,
        "ended_at": start + timedelta(seconds=seconds),
        "start_station_name": "A",
        "end_station_name": "B",
        "start_lat": 41.88,
        "start_lng": -87.63,
        "end_lat": 41.90,
        "end_lng": -87.63,
        "member_casual": "member",
    }
    unknown = set(values) - set(row)
    assert not unknown, unknown
    return {**row, **values}


def trips(spark, *rows: dict):
    return spark.createDataFrame([tuple(r[c] for c in SOURCE_COLUMNS) for r in rows], TRIPS)


def many(count: int, prefix: str = "R", **values) -> list[dict]:
    return [trip(f"{prefix}{i}", **values) for i in range(count)]


def rows(table) -> list[dict]:
    return [r.asDict() for r in table.collect()]


def by(table, *keys: str) -> dict:
    found = {}
    for r in rows(table):
        key = r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)
        assert key not in found
        found[key] = r
    return found
