"""The physical plans have the properties the design relies on."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from spokeframe.operators import cleaning, measures, profile, quantiles, stations, summaries
from spokeframe.plans import REPORTS, RideTables
from spokeframe.schema import SOURCE_COLUMNS
from spokeframe.session import cluster_settings


def plan(table) -> str:
    return table._jdf.queryExecution().executedPlan().toString()


def read_columns(text: str) -> list[set[str]]:
    return [
        set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text)
    ]


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return RideTables.from_lineitem(spark, sf_dir)


@pytest.fixture(scope="module")
def trips(tables):
    return tables.trips()


@pytest.fixture(scope="module")
def rides(tables):
    return tables.rides()


def test_cleaning_is_one_pass_with_one_distance_call(trips):
    text = plan(cleaning.clean_rides(trips, SOURCE_COLUMNS))
    assert text.count("ArrowEvalPython") == 1
    assert "Exchange" not in text and "Sort" not in text
    # The presence test reaches the scan.
    assert "IsNotNull(end_lat)" in text


def test_cheap_filters_run_before_the_distance(trips):
    lines = plan(cleaning.clean_rides(trips, SOURCE_COLUMNS)).splitlines()
    python = next(i for i, line in enumerate(lines) if "ArrowEvalPython" in line)
    below = "\n".join(lines[python + 1 :])
    assert "Charge" in below and "ended_at" in below and "isnotnull(end_lng" in below


def test_summaries_read_only_their_columns(rides):
    text = plan(summaries.total_monthly_rides(measures.facts(rides)))
    assert read_columns(text) == [{"month"}]
    text = plan(summaries.user_type_monthly_calc(measures.facts(rides)))
    assert read_columns(text) == [{"month", "member_casual", "ride_length", "ride_distance"}]


@pytest.mark.parametrize("side", ["start", "end"])
def test_station_counts_push_down_and_combine_before_the_shuffle(rides, side):
    text = plan(stations.station_counts(rides, side))
    name = stations.station_column(side)
    assert read_columns(text) == [{name, "member_casual", "month"}]
    assert f"IsNotNull({name})" in text and f"Not(EqualTo({name},))" in text
    assert text.index("Exchange") < text.index("partial_count")
    assert "SortAggregate" not in text


def test_distinct_rides_spread_a_station_by_ride_id(rides):
    text = plan(stations.distinct_rides(rides, "start"))
    assert "SortAggregate" not in text
    exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", text)
    assert len(exchanges) == 2
    assert "ride_id" in exchanges[1] and "start_station_name" in exchanges[1]
    assert read_columns(text) == [{"ride_id", "start_station_name", "member_casual"}]


def test_rider_filter_of_a_direct_count_reaches_the_scan(rides):
    counts = stations.station_counts(rides, "start").where(F.col("member_casual") == "member")
    assert "EqualTo(member_casual,member)" in plan(counts)


def test_reports_take_the_top_without_a_full_sort(rides):
    counts = stations.station_counts(rides, "start")
    assert "TakeOrderedAndProject" in plan(stations.top_stations(counts, "start"))
    assert "TakeOrderedAndProject" in plan(stations.top_stations_by(counts, "start"))


def test_top_n_trims_groups_before_the_shuffle(rides):
    counts = stations.station_counts(rides, "start")
    text = plan(stations.top_n_with_ties(counts, ["month"], "rides", 3))
    assert text.count("WindowGroupLimit") == 2


def test_quantiles_broadcast_only_brackets(rides):
    values = profile.long_form(rides.select("ride_length", "start_lat"))
    text = plan(quantiles.exact_quantiles(values, [0.5]))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert all(c == {"ride_length", "start_lat"} for c in read_columns(text))


def test_no_report_uses_a_nested_loop_join(tables):
    for name, report in REPORTS.items():
        text = plan(report(tables))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_cluster_settings_grow_with_the_input():
    small, large = cluster_settings(10**9), cluster_settings(100 * 10**12)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert int(small[key]) == 200 and int(large[key]) == 100 * 10**12 // (512 * 1024**2)
    assert int(large["spark.sql.files.maxPartitionBytes"]) > int(small["spark.sql.files.maxPartitionBytes"])


def test_rides_are_not_shuffled_to_pick_a_station_point(tables, rides):
    keep = tables.keep("start_shortest")
    assert "SortAggregate" not in plan(stations.shortest_rides(rides, "start"))
    text = plan(stations.representative_points(rides, "start", keep))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_rows_without_a_repeated_hash_are_not_shuffled(tables, trips):
    keep = tables.keep("repeated_hashes_of_all_trips")
    text = plan(profile.repeated_rows(trips, SOURCE_COLUMNS, keep))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_tables_under_one_name_are_told_apart(spark, tables):
    keep = tables.keep("same_name")
    assert [keep(spark.range(n)).count() for n in (7, 3)] == [7, 3]


def test_a_local_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from spokeframe.session import shared_folder

    def session(master, folder):
        conf = SimpleNamespace(get=lambda *_: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="do not share"):
        shared_folder(session("yarn", "file:///tmp/x"))
    assert shared_folder(session("yarn", "hdfs://n/x")) == "hdfs://n/x"
    assert shared_folder(session("local-cluster[2,1,1024]", "file:///tmp/x")) == "file:///tmp/x"
    assert shared_folder(session("yarn", None)) is None
