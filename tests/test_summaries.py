from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import by, many, rows, trip, trips
from spokeframe.operators import charts, cleaning, measures, summaries


@pytest.fixture(scope="module")
def facts_of(spark):
    def make(*trip_rows: dict):
        return measures.rollup(cleaning.clean_rides(trips(spark, *trip_rows)))

    return make


def test_share_is_within_the_bike_type(facts_of):
    facts = facts_of(
        *many(2, "c", rideable_type="electric_bike", member_casual="casual"),
        *many(1, "m", rideable_type="electric_bike", member_casual="member"),
        *many(3, "d", rideable_type="docked_bike", member_casual="casual"),
    )
    found = by(summaries.user_type_ride_type(facts), "rideable_type", "member_casual")
    assert found["electric_bike", "casual"]["percentage"] == 67.0
    assert found["electric_bike", "member"]["percentage"] == 33.0
    assert found["docked_bike", "casual"]["percentage"] == 100.0
    assert found["docked_bike", "casual"]["type_rank"] == 3
    of_user = by(summaries.bike_type_by_user(facts), "rideable_type", "member_casual")
    assert of_user["electric_bike", "casual"]["percent_of_user"] == 40.0
    assert of_user["electric_bike", "member"]["percent_of_user"] == 100.0


def test_half_percent_goes_to_even(facts_of):
    facts = facts_of(*many(1, "c", member_casual="casual"), *many(7, "m"))
    found = by(summaries.total_daily_rides(facts), "member_casual")
    assert (found["casual"]["percent"], found["member"]["percent"]) == (12.0, 88.0)
    two_digits = by(summaries.user_rides(facts), "member_casual")
    assert two_digits["casual"]["percent"] == 12.5


def test_unknown_rider_type(facts_of):
    facts = facts_of(*many(1, "g", member_casual="guest"), *many(3, "m"))
    monthly = by(summaries.user_type_monthly_data(facts), "member_casual")
    assert monthly["guest"]["percentage"] is None
    assert monthly["member"]["percentage"] == 75.0
    bikes = by(summaries.user_type_ride_type(facts), "member_casual")
    assert bikes["guest"]["percentage"] is None
    daily = by(summaries.total_daily_rides(facts), "member_casual")
    assert daily["guest"]["percent"] == 25.0
    assert by(summaries.rides_summary(facts), "member_casual")["guest"]["total_rides"] == 1


def test_total_row_and_missing_rider_type(spark, facts_of):
    facts = facts_of(*many(2, "c", member_casual="casual"), *many(3, "m"))
    found = by(summaries.rides_summary(facts), "member_casual")
    assert {k: v["total_rides"] for k, v in found.items()} == {"casual": 2, "member": 3, "Total": 5}
    unnamed = facts.withColumn("member_casual", F.nullif("member_casual", F.lit("casual")))
    relabelled = sorted((r["member_casual"], r["total_rides"]) for r in rows(summaries.rides_summary(unnamed)))
    assert relabelled == [("Total", 2), ("Total", 5), ("member", 3)]


def test_totals_and_means(facts_of):
    facts = facts_of(trip("a", seconds=600), trip("b", seconds=660), trip("c", seconds=607))
    found = rows(summaries.user_type_monthly_calc(facts))
    assert len(found) == 1
    assert found[0]["month"] == "03"
    assert found[0]["number_of_rides"] == 3
    assert found[0]["total_ride_time"] == 31.12
    assert found[0]["average_ride_time"] == 31.12 / 3


def test_rides_and_their_rollup_give_equal_tables(spark, sf_dir):
    from spokeframe.sources import trips_from_lineitem

    rides = cleaning.clean_rides(trips_from_lineitem(spark, sf_dir)).cache()
    single, rolled = measures.facts(rides), measures.rollup(rides).cache()
    assert rolled.count() < single.count()
    for table in (
        summaries.user_rides,
        summaries.daily_rides_user_type,
        summaries.total_rideable_type,
        summaries.rides_by_hour_user_type,
        charts.user_type_totals,
    ):
        assert sorted(table(single).collect()) == sorted(table(rolled).collect())
    # The order and placement of the rows changes nothing, to the last digit.
    shuffled = measures.rollup(rides.repartition(7, "ride_id").sortWithinPartitions(F.desc("ride_length")))
    assert sorted(shuffled.collect()) == sorted(rolled.collect())
    rides.unpersist()


def test_shares_add_up(spark, sf_dir):
    from spokeframe.plans import QUERIES

    def total(name: str, share: str, *within: str) -> list[float]:
        table = QUERIES[name](spark, sf_dir)
        return [r["s"] for r in rows(table.groupBy(*within).agg(F.sum(share).alias("s")))]

    assert total("user_rides", "percent") == [pytest.approx(100, abs=0.011)]
    for sums in (
        total("user_type_monthly_data", "percentage", "month"),
        total("total_daily_rides", "percent", "day_of_week"),
        total("user_type_ride_type", "percentage", "rideable_type"),
    ):
        assert all(abs(s - 100) <= 1 for s in sums)


def test_month_breaks(facts_of):
    facts = facts_of(trip("a", start=datetime(2022, 2, 1)), trip("b", start=datetime(2022, 8, 1)))
    found = by(summaries.month_breaks(facts, 4), "position")
    assert [found[i]["month_break"] for i in range(4)] == [2.0, 4.0, 6.0, 8.0]


def test_user_share_chart(facts_of):
    facts = facts_of(*many(1, "c", member_casual="casual"), *many(2, "m"))
    found = by(charts.user_share(facts), "member_casual")
    assert found["casual"]["slice_label"] == "33%"
    assert found["member"]["legend_label"] == "Member (2)"


def test_monthly_chart(facts_of):
    facts = facts_of(trip("a", start=datetime(2022, 2, 1)), trip("b", start=datetime(2022, 12, 1)))
    found = by(charts.monthly_rides(facts), "month")
    assert {k: v["month_label"] for k, v in found.items()} == {2: "Feb", 12: "Dec"}
