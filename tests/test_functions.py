from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spokeframe.functions import calendar, labels, rounding


def one(spark, column, value, type_):
    return spark.createDataFrame([(value,)], f"x {type_}").select(column(F.col("x"))).collect()[0][0]


@pytest.mark.parametrize(
    "value, digits, expected",
    [
        (12.5, 0, 12.0),
        (87.5, 0, 88.0),
        (0.5, 0, 0.0),
        (7.125, 2, 7.12),
        (7.375, 2, 7.38),
        (2.675, 2, 2.67),
        (-7.125, 2, -7.12),
        (1.0167, 2, 1.02),
        (4.25, 1, 4.2),
        (5.0, 2, 5.0),
        (None, 2, None),
    ],
)
def test_round_half_even(spark, value, digits, expected):
    assert one(spark, lambda x: rounding.round_half_even(x, digits), value, "double") == expected


def test_nearest_and_hundredths(spark):
    assert one(spark, lambda x: rounding.nearest(x, 2), 1.0166666, "double") == 1.02
    assert one(spark, rounding.hundredths, 0.29, "double") == 29


@pytest.mark.parametrize(
    "number, text",
    [
        (7, "7"),
        (999, "999"),
        (1000, "1K"),
        (25000, "25K"),
        (999949, "999.9K"),
        (1234567, "1.2M"),
        (50_000_000_000, "50000M"),
        (None, None),
    ],
)
def test_short_count(spark, number, text):
    assert one(spark, labels.short_count, number, "bigint") == text


def test_other_labels(spark):
    assert one(spark, labels.thousands, 1234567, "bigint") == "1,234,567"
    assert one(spark, labels.percent_label, 43.0, "double") == "43%"
    assert one(spark, labels.spaced, "electric_bike", "string") == "electric bike"
    assert one(spark, lambda x: labels.level_rank(x, ["b", "a"]), "a", "string") == 2
    assert one(spark, lambda x: labels.level_rank(x, ["b", "a"]), "c", "string") is None
    assert one(spark, lambda x: labels.legend_label(x, F.lit(1234)), "casual", "string") == "Casual (1,234)"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2022-01-05 07:08:09", datetime(2022, 1, 5, 7, 8, 9)),
        ("2022-02-29 00:00:00", None),
        ("2022-01-05", None),
        ("bad", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_timestamp(spark, text, expected):
    assert one(spark, calendar.parse_timestamp, text, "string") == expected


@pytest.mark.parametrize("zone", ["UTC", "America/Chicago"])
def test_clock_changes_do_not_matter(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        table = spark.createDataFrame([("2022-03-13 01:45:00", "2022-03-13 02:30:00.5")], "a string, b string")
        start, end = (calendar.parse_timestamp(F.col(c)) for c in "ab")
        seconds, hour = table.select(calendar.seconds_between(start, end), F.hour(end)).collect()[0]
        assert (seconds, hour) == (2700.5, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    "text",
    [
        "2022-03-05 08:07:09",
        "2022-3-5T8:7:9",
        "2022/03/05 08:07:09",
        "2022.03.05 08.07.09",
        " 2022_03_05  08-07-09 ",
        "2022/3/5, 8:7:9",
        "2022-03-05T08:07:09Z",
        "20220305 080709",
        "20220305T080709Z",
        "20220305080709",
    ],
)
def test_timestamps_with_other_separators(spark, text):
    assert one(spark, calendar.parse_timestamp, text, "string") == datetime(2022, 3, 5, 8, 7, 9)


def test_fractions_of_seconds_are_kept(spark):
    for text in ("2022/03/05 08:07:09.25", "20220305080709.25"):
        assert one(spark, calendar.parse_timestamp, text, "string") == datetime(2022, 3, 5, 8, 7, 9, 250000)


@pytest.mark.parametrize(
    "text",
    [
        None,
        "",
        "2022/03-05 08:07:09",
        "05/03/2022 08:07:09",
        "2022/02/30 08:07:09",
        "20220230080709",
        "2022/03/05 24:07:09",
        "2022/03/05",
        "2022/03/05 08:07",
        "202235 8709",
        "2022305080709",
        "2022-03-05 08:07:09+02:00",
        "2022-03-05 08:07:09 PM",
    ],
)
def test_what_is_no_timestamp(spark, text):
    assert one(spark, calendar.parse_timestamp, text, "string") is None
