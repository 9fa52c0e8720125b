from __future__ import annotations

import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import by, rows, trip, trips
from spokeframe.operators import cleaning
from spokeframe.schema import MONTHS, SOURCE_COLUMNS
from spokeframe.sinks import ROW_NUMBER, write_csv, write_ranked_csv
from spokeframe.sources import month_of_path, month_paths, read_trips

HEADER = list(SOURCE_COLUMNS)


def line(ride_id: str, month: int = 1, **values: str) -> dict[str, str]:
    row = {
        "ride_id": ride_id,
        "rideable_type": "classic_bike",
        "started_at": f"2022-{month:02d}-05 08:00:00",
        "ended_at": f"2022-{month:02d}-05 08:10:00",
        "start_station_name": "A",
        "end_station_name": "B",
        "start_lat": "41.88",
        "start_lng": "-87.63",
        "end_lat": "41.9",
        "end_lng": "-87.63",
        "member_casual": "member",
    }
    return {**row, **values}


def write(path, lines: list[dict[str, str]], header: list[str] = HEADER) -> str:
    text = [",".join(header)] + [",".join(r[c] for c in header) for r in lines]
    path.write_text("\n".join(text) + "\n")
    return str(path)


@pytest.fixture()
def year(tmp_path):
    for number, name in enumerate(MONTHS, start=1):
        lines = [line(f"{name}{i}", number) for i in range(number)]
        # Every other file lists its columns the other way round.
        write(tmp_path / f"{name}_trips.csv", lines, HEADER if number % 2 else HEADER[::-1])
    return str(tmp_path)


def test_twelve_files_matched_by_header_name(spark, year):
    table = read_trips(spark, month_paths(year), source_column="path")
    per_file = by(table.groupBy(month_of_path(F.col("path")).alias("file")).count(), "file")
    assert {k: v["count"] for k, v in per_file.items()} == {m: i for i, m in enumerate(MONTHS, start=1)}
    clean = cleaning.clean_rides(table.drop("path"))
    months = by(clean.groupBy("month").count(), "month")
    assert {int(k): v["count"] for k, v in months.items()} == {i: i for i in range(1, 13)}
    assert clean.first()["start_lat"] == 41.88


def test_files_of_one_layout_are_one_scan(spark, year):
    odd = month_paths(year)[::2]
    table = read_trips(spark, odd)
    assert len(table.inputFiles()) == 6
    assert "Union" not in table._jdf.queryExecution().toString()


def test_missing_and_blank_fields(spark, tmp_path):
    path = write(
        tmp_path / "t.csv",
        [
            line("blank name", start_station_name=""),
            line("quoted blank name", start_station_name='""'),
            line("NA name", start_station_name="NA"),
            line("blank place", end_lat=""),
            line("NA place", end_lat="NA"),
            line("bad place", end_lat="north"),
            line("bad time", started_at="bad"),
            line("comma", start_station_name='"A, B"'),
            line("quote", start_station_name='"A ""x"" \\ B"'),
        ],
    )
    table = read_trips(spark, [path])
    names = {k: v["start_station_name"] for k, v in by(table, "ride_id").items()}
    assert names["blank name"] == names["quoted blank name"] == ""
    assert names["NA name"] is None
    assert names["comma"] == "A, B"
    assert names["quote"] == 'A "x" \\ B'
    complete = {r["ride_id"] for r in rows(cleaning.drop_incomplete(table))}
    assert complete == {"blank name", "quoted blank name", "bad time", "comma", "quote"}
    clean = {r["ride_id"] for r in rows(cleaning.clean_rides(table))}
    assert clean == complete - {"bad time"}


def test_extra_columns_are_carried(spark, tmp_path):
    header = [*HEADER, "start_station_id"]
    path = write(tmp_path / "t.csv", [{**line("a"), "start_station_id": "TA13"}], header)
    assert rows(read_trips(spark, [path]))[0]["start_station_id"] == "TA13"


def test_layout_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="no trip files"):
        read_trips(spark, [])
    short = write(tmp_path / "short.csv", [line("a")], HEADER[:-1])
    with pytest.raises(ValueError, match="lacks"):
        read_trips(spark, [short])
    full = write(tmp_path / "full.csv", [line("a")])
    more = write(tmp_path / "more.csv", [{**line("a"), "x": "1"}], [*HEADER, "x"])
    with pytest.raises(ValueError, match="differs"):
        read_trips(spark, [full, more])


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "t.csv", [line("a", start_station_name='"A\nB"')])
    assert [r["start_station_name"] for r in rows(read_trips(spark, [path], multiline=True))] == ["A\nB"]


def test_ranked_csv(spark, tmp_path):
    table = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9)], "name string, total bigint").repartition(3)
    path = str(tmp_path / "out")
    write_ranked_csv(table, path, [F.desc("total"), F.asc("name")], rows=3)
    back = spark.read.option("header", True).csv(path)
    assert back.columns[0] == ROW_NUMBER
    assert [tuple(r) for r in back.collect()] == [("1", "c", "9"), ("2", "a", "5"), ("3", "b", "5")]


def test_csv_round_trip(spark, tmp_path):
    table = trips(spark, trip("a", start_station_name='x "y", z'), trip("b", start=datetime(2022, 5, 1, 1, 2, 3)))
    path = str(tmp_path / "out")
    text = table.withColumns({c: F.col(c).cast("string") for c in ("started_at", "ended_at")})
    write_csv(text, path)
    back = cleaning.parse_times(read_trips(spark, [path])).select(*SOURCE_COLUMNS)
    assert sorted(back.collect()) == sorted(table.collect())


def test_headers_are_matched_inside_a_folder(spark, tmp_path):
    from spokeframe.schema import SOURCE_COLUMNS
    from spokeframe.sources import read_trips

    for name, columns in (("a", list(SOURCE_COLUMNS)), ("b", list(reversed(SOURCE_COLUMNS)))):
        (tmp_path / f"{name}.csv").write_text(",".join(columns) + "\n" + ",".join(f"v{c}" for c in columns) + "\n")
    (tmp_path / "empty.csv").write_text("")
    for paths in ([str(tmp_path)], [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]):
        found = read_trips(spark, paths).collect()
        stations = [(r.start_station_name, r.end_station_name) for r in found]
        assert stations == [("vstart_station_name", "vend_station_name")] * 2


def test_headers_of_compressed_and_oddly_named_files(spark, tmp_path):
    lines = ",".join(HEADER) + "\n" + ",".join(line("zipped").values()) + "\n"
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(lines.encode()))
    write(tmp_path / "b [1] {x} 100%.csv", [line("odd")], HEADER[::-1])
    found = {r.ride_id: r.start_station_name for r in read_trips(spark, [str(tmp_path)]).collect()}
    assert found == {"zipped": "A", "odd": "A"}
