"""Months added to a folder, and files rewritten, within one session."""

from __future__ import annotations

import pytest

from helpers import rows
from spokeframe import REPORTS, RideTables
from spokeframe.operators import cleaning, measures
from spokeframe.plans import file_parts
from spokeframe.sources import read_trips
from test_csv import HEADER, line, write


@pytest.fixture()
def read(monkeypatch):
    """The names of the files that each call read."""
    calls: list[list[str]] = []

    def spy(spark, paths, **options):
        calls.append(sorted(p.rsplit("/", 1)[-1] for p in paths))
        return read_trips(spark, paths, **options)

    monkeypatch.setattr(file_parts, "read_trips", spy)
    return calls


def both_ways(spark, folder):
    """The facts from parts, checked against those of all files at once."""
    tables = RideTables.from_files(spark, [folder])
    whole = measures.rollup(cleaning.clean_rides(read_trips(spark, [folder])))
    assert sorted(tables.facts().collect()) == sorted(whole.collect())
    assert tables.rides().count() == cleaning.clean_rides(read_trips(spark, [folder])).count()
    return {r["month"]: r["rides"] for r in rows(REPORTS["total_monthly_rides"](tables))}


def test_only_new_and_rewritten_files_are_read(spark, tmp_path, read):
    folder = tmp_path / "trips"
    folder.mkdir()
    write(folder / "jan.csv", [line("a", 1), line("b", 1)])
    write(folder / "feb.csv", [line("c", 2)], HEADER[::-1])
    assert both_ways(spark, str(folder)) == {"01": 2, "02": 1}
    assert read == [["feb.csv", "jan.csv"]]

    write(folder / "mar.csv", [line("d", 3), line("bad", 3, ended_at="never")])
    assert both_ways(spark, str(folder)) == {"01": 2, "02": 1, "03": 1}
    assert read[1:] == [["mar.csv"]]

    write(folder / "jan.csv", [line("a", 1), line("b", 1), line("e", 1)])
    assert both_ways(spark, str(folder)) == {"01": 3, "02": 1, "03": 1}
    assert read[2:] == [["jan.csv"]]

    (folder / "feb.csv").unlink()
    assert both_ways(spark, str(folder)) == {"01": 3, "03": 1}
    assert both_ways(spark, str(folder)) == {"01": 3, "03": 1}
    assert len(read) == 3


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="no trip files"):
        RideTables.from_files(spark, [str(tmp_path)]).rides()
    (tmp_path / "blank.csv").write_text("\n\n")
    with pytest.raises(ValueError, match="no trip files"):
        RideTables.from_files(spark, [str(tmp_path)]).rides()
    write(tmp_path / "header.csv", [])
    assert RideTables.from_files(spark, [str(tmp_path)]).rides().count() == 0


def test_files_are_cleaned_in_methods_that_get_compiled(spark, tmp_path, monkeypatch):
    """The JVM interprets a method of more than 8000 bytes, which took twice the time per row."""
    key, seen = "spark.sql.codegen.hugeMethodLimit", []
    clean = cleaning.clean_rides

    def spy(trips):
        seen.append(spark.conf.get(key))
        return clean(trips)

    monkeypatch.setattr(file_parts.cleaning, "clean_rides", spy)
    write(tmp_path / "jan.csv", [line("a", 1), line("b", 1)])
    before = spark.conf.get(key)
    assert RideTables.from_files(spark, [str(tmp_path)]).rides().count() == 2
    assert seen == ["8000"] and spark.conf.get(key) == before
