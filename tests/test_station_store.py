"""Station tables from mergeable monthly states."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from helpers import T0, rows, trip, trips
from pyspark.sql import functions as F

from spokeframe.operators import cleaning, station_state, stations
from spokeframe.plans.station_store import SIDES, StationStates

KEY = ("rider_group",)


@pytest.fixture(scope="module")
def rides(spark):
    """Three months; ride ids that come back in another month, at the same station or not, and missing values."""
    rng = random.Random(2)
    made = []
    for i in range(900):
        ride_id = f"R{rng.randrange(500)}" if i % 90 else "hot"
        where = "A" if i % 3 == 0 else rng.choice(["A", "B", "C", "D", ""])
        who = rng.choice(["member", "casual"])
        start = T0 + timedelta(days=30 * (i % 3), minutes=i)
        made.append(trip(ride_id, rng.randrange(60, 4000), start, start_station_name=where, member_casual=who, start_lat=41.8 + rng.random() / 100))
    clean = cleaning.clean_rides(trips(spark, *made)).cache()
    odd = clean.limit(40).withColumns({"ride_id": F.lit(None).cast("string"), "member_casual": F.lit(None).cast("string")})
    other = clean.limit(30).withColumn("member_casual", F.lit("guest"))
    return clean.unionByName(odd).unionByName(other).repartition(5).cache()


def activity(table, side):
    return {(r[stations.station_column(side)], r["rider_group"]): r for r in rows(table)}


@pytest.mark.parametrize("groups", [[["03"], ["04"], ["05"]], [["03", "04"], ["05"]], [["05"], ["03"], ["04"]], [["03", "04", "05"]]])
def test_parts_added_one_by_one_equal_all_at_once(spark, tmp_path, rides, groups):
    states = StationStates(spark, str(tmp_path / "states"))
    for group in groups:
        states.add("-".join(group), rides.where(F.col("month").isin(group)))
    assert states.parts() == {"-".join(g): k for k, g in enumerate(groups)}
    for side in SIDES:
        assert activity(states.activity(side), side) == activity(stations.station_activity(rides, side), side)


def test_old_rides_are_not_read_again(spark, tmp_path, rides):
    """A month's rides stand in files of their own, which are gone when the next month is added."""
    states = StationStates(spark, str(tmp_path / "states"))
    read = set()
    for month in ("03", "04", "05"):
        path = str(tmp_path / f"rides-{month}")
        rides.where(F.col("month") == month).write.parquet(path)
        month_rides = spark.read.parquet(path)
        states.add(month, month_rides)
        month_rides.unpersist()
        for file in (tmp_path / f"rides-{month}").glob("*.parquet"):
            file.write_bytes(b"")  # no longer a table: reading it would fail
    for side in SIDES:
        merged = states.activity(side)
        read.update(f.split("/states/")[0] for f in merged.inputFiles())
        assert all("/states/" in f for f in merged.inputFiles())
        assert activity(merged, side) == activity(stations.station_activity(rides, side), side)
    assert len(read) == 1


def test_numbers_are_given_once(spark, tmp_path, rides):
    states = StationStates(spark, str(tmp_path / "states"))
    for month in ("03", "04", "05"):
        states.add(month, rides.where(F.col("month") == month))
    numbers = spark.read.parquet(str(tmp_path / "states" / "numbers"))
    ids = rides.select("ride_id").distinct().count()
    assert numbers.count() == ids == numbers.select("ride_id").distinct().count() == numbers.select("number").distinct().count()


def test_no_two_tasks_fill_the_same_bitmap(spark, tmp_path, rides):
    """Else each task holds a nearly empty copy of every other task's bitmaps."""
    path = str(tmp_path / "numbered")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        station_state.numbered_rides(rides, 1).write.parquet(path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    numbered = spark.read.parquet(path).select("*", F.input_file_name().alias("task"))
    tasks = numbered.groupBy(F.bitmap_bucket_number("number").alias("bucket")).agg(F.count_distinct("task").alias("tasks"))
    assert numbered.select("task").distinct().count() > 1
    assert {r["tasks"] for r in tasks.collect()} == {1}
    # A ride keeps its number, in this part and in later ones.
    assert numbered.count() == rides.count()
    assert numbered.groupBy("ride_id").agg(F.count_distinct("number").alias("n")).where("n > 1").count() == 0
    known = station_state.numbers_of(spark.read.parquet(path))
    assert known.count() == known.select("number").distinct().count() == rides.select("ride_id").distinct().count()
    again = station_state.numbered_rides(rides, 2, known)
    assert again.where("is_new").count() == 0 and again.count() == rides.count()
    same = again.select("ride_id", "number").distinct()
    assert sorted(same.collect(), key=str) == sorted(known.collect(), key=str)


def test_rides_move_once(spark, rides):
    """One shuffle gives the numbers, and none but that of finished bitmaps follows."""
    plan = station_state.numbered_rides(rides, 0)._jdf.queryExecution().sparkPlan().toString()
    executed = station_state.numbered_rides(rides, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert executed.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in executed


def test_a_stopped_attempt_leaves_nothing_behind(spark, tmp_path, rides, monkeypatch):
    states = StationStates(spark, str(tmp_path / "states"))
    states.add("03", rides.where("month = '03'"))
    with monkeypatch.context() as broken:
        broken.setattr(station_state, "part_points", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            states.add("04", rides.where("month = '04'"))
    assert list(states.parts()) == ["03"]
    before = activity(states.activity("start"), "start")
    assert before == activity(stations.station_activity(rides.where("month = '03'"), "start"), "start")
    states.add("04", rides.where("month = '04'"))
    assert activity(states.activity("start"), "start") == activity(
        stations.station_activity(rides.where("month IN ('03', '04')"), "start"), "start"
    )


def test_wrong_parts_are_refused_and_empty_ones_are_not(spark, tmp_path, rides):
    states = StationStates(spark, str(tmp_path / "states"))
    with pytest.raises(ValueError, match="no part"):
        states.activity("start")
    for name in ("", "a/b", "a=b"):
        with pytest.raises(ValueError, match="name"):
            states.add(name, rides)
    states.add("none", rides.where("false"))
    assert states.activity("start").count() == 0
    states.add("all", rides)
    with pytest.raises(ValueError, match="already"):
        states.add("all", rides)
    assert activity(states.activity("end"), "end") == activity(stations.station_activity(rides, "end"), "end")
    with pytest.raises(ValueError, match="1024"):
        station_state.new_ride_numbers(rides, 1024)
