"""The reports over a folder of monthly CSV files, end to end."""

from __future__ import annotations

import pytest

from spokeframe.__main__ import TRIP_TABLES, main
from spokeframe.operators import stations
from spokeframe.plans import QUERIES, REPORTS, RideTables
from spokeframe.sinks import ROW_NUMBER


@pytest.fixture(scope="module")
def csv_tables(spark, sf_dir):
    """The exported months of the test data, read back as a CSV source."""
    exported = RideTables.from_lineitem(spark, sf_dir).month_files()
    return RideTables.from_files(spark, exported)


@pytest.mark.parametrize(
    "name",
    ["trips_by_month_file", "rides_summary", "user_type_monthly_calc", "casual_rides_ended", "profile_numeric"],
)
def test_csv_source_gives_the_same_report(spark, sf_dir, csv_tables, name):
    assert sorted(REPORTS[name](csv_tables).collect()) == sorted(QUERIES[name](spark, sf_dir).collect())


def test_command_line(spark, sf_dir, csv_tables, tmp_path, monkeypatch):
    monkeypatch.setattr(RideTables, "from_csv", classmethod(lambda cls, s, folder: csv_tables))
    out = str(tmp_path / "out")
    main(["unused", out, "--report", "user_rides"])
    assert spark.read.option("header", True).csv(f"{out}/user_rides").count() == 2
    assert set(TRIP_TABLES) < set(REPORTS)


def test_map_tables_are_written_in_order(spark, csv_tables, tmp_path):
    from spokeframe.plans import write_map_tables

    write_map_tables(csv_tables, str(tmp_path))
    for name, options in stations.MAP_TABLES.items():
        lines = [r.asDict() for r in spark.read.option("header", True).csv(f"{tmp_path}/{name}").collect()]
        assert [int(r[ROW_NUMBER]) for r in lines] == list(range(1, len(lines) + 1))
        totals = [int(r["total_rides"]) for r in lines]
        assert totals == sorted(totals, reverse=True) and len(lines) <= options["max_rows"]
