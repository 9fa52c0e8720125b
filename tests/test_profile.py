from __future__ import annotations

import random

import numpy as np
import pytest

from helpers import by, many, rows, trip, trips
from spokeframe.operators import cleaning, profile, quantiles
from spokeframe.plans import store


def test_duplicates(spark):
    single = trips(spark, trip("a"), trip("b"), trip("a", seconds=700))
    assert rows(profile.has_duplicate_trips(single)) == [{"has_duplicates": False}]
    double = trips(spark, trip("a"), trip("b"), trip("a"))
    assert rows(profile.has_duplicate_trips(double)) == [{"has_duplicates": True}]
    assert [r["copies"] for r in rows(profile.repeated_rows(double))] == [2]
    # Cleaning does not remove copies.
    assert cleaning.clean_rides(double).count() == 3


def test_duplicates_with_missing_values_and_many_copies(spark):
    table = trips(spark, *[trip("hot")] * 500, *many(300), trip("n", end_lat=None), trip("n", end_lat=None))
    found = by(profile.repeated_rows(table), "ride_id")
    assert {k: v["copies"] for k, v in found.items()} == {"hot": 500, "n": 2}


def test_numeric_profile(spark):
    table = spark.createDataFrame([(1.0, None), (2.0, float("nan")), (4.0, 3.0), (None, 5.0)], "x double, y double")
    found = by(profile.profile_numeric(table), "column")
    x = found["x"]
    assert (x["minimum"], x["first_quartile"], x["median"], x["third_quartile"], x["maximum"]) == (1, 1.5, 2, 3, 4)
    assert x["mean"] == pytest.approx(7 / 3)
    assert (x["na_count"], found["y"]["na_count"]) == (1, 2)
    assert found["y"]["median"] == 4.0


def test_all_missing_column(spark):
    table = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    found = by(profile.profile_numeric(table), "column")
    assert found["y"]["median"] is None and found["y"]["na_count"] == 2


@pytest.mark.parametrize("bins, passes", [(quantiles.BINS, 2), (3, 3), (quantiles.BINS, 1)])
def test_quantiles_agree_with_brute_force(spark, monkeypatch, bins, passes):
    """Skewed values, a third of them equal; also with so few bins that many values are left."""
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(3)
    columns = {
        "hot": [7.0 if i % 3 == 0 else rng.gauss(7, 3) for i in range(20_000)],
        "tail": [rng.expovariate(1) ** 6 for _ in range(20_000)],
        "few": [float(rng.randrange(3)) for _ in range(5_001)],
        "one": [2.5],
        "gap": [0.0] * 10 + [1e12] * 10,
    }
    long = spark.createDataFrame(
        [(name, v) for name, values in columns.items() for v in values], "column string, value double"
    ).repartition(6)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    found = by(quantiles.exact_quantiles(long, probs, passes), "column", "prob")
    for name, values in columns.items():
        for p in probs:
            assert found[name, p]["quantile"] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)


def test_quantiles_of_outliers_at_several_scales_leave_few_values_to_rank(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST_LEFT", 500, raising=False)
    rng = random.Random(4)
    columns = {
        "two scales": [rng.random() for _ in range(20_000)] + [1e9, 1e18],
        "narrow": [1 + rng.random() * 1e-9 for _ in range(20_000)] + [1.5, 1.001, -1e200, 0.0, 1e200],
        "ends": [rng.random() for _ in range(5_000)] + [-1.7e308, 1.7e308, float("inf"), 5e-324],
    }
    long = spark.createDataFrame(
        [(name, v) for name, values in columns.items() for v in values], "column string, value double"
    ).repartition(6)
    ranked = []
    before = quantiles._with_before

    def noted(counted, order, *keys):
        if order == "value":
            ranked.extend(r["count"] for r in counted.groupBy(*keys).count().collect())
        return before(counted, order, *keys)

    monkeypatch.setattr(quantiles, "_with_before", noted)
    probs = (0.25, 0.5, 0.75)
    found = by(quantiles.exact_quantiles(long, probs), "column", "prob")
    assert ranked and max(ranked) <= 500
    for name, values in columns.items():
        for p in probs:
            assert found[name, p]["quantile"] == pytest.approx(np.quantile(np.sort(values), p), rel=1e-12)


def test_text_profile_and_shape(spark):
    table = trips(spark, trip("a", start_station_name=""), trip("b", end_station_name=None))
    text = by(profile.profile_text(table), "column")
    assert text["start_station_name"]["blank_count"] == 1
    assert text["end_station_name"]["na_count"] == 1
    assert text["ride_id"]["length"] == 2
    shape = by(profile.profile_shape(table), "column")
    assert shape["end_station_name"]["filled_rows"] == 1
    assert shape["ride_id"]["column_count"] == 11


def test_cleaning_audit(spark):
    table = trips(
        spark,
        trip("good"),
        trip("missing", end_lat=None),
        trip("short", seconds=30),
        trip("still", end_lat=41.88),
        trip("service", start_station_name="Charge", seconds=30),
        trip("test", end_station_name="Hubbard Bike-checking (LBS-WH-TEST)"),
    )
    assert rows(profile.cleaning_audit(table)) == [
        {
            "rows_read": 6,
            "rows_incomplete": 1,
            "rows_too_short": 2,
            "rows_without_distance": 1,
            "rows_maintenance_start": 1,
            "rows_maintenance_end": 1,
            "rows_clean": 1,
        }
    ]


def test_tables_are_written_once_in_the_configured_folder(spark, tmp_path, monkeypatch):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    monkeypatch.setattr(store, "_FOLDERS", {})
    monkeypatch.setattr(store, "_WRITTEN", {})
    monkeypatch.setattr(store, "shared_folder", lambda _: str(tmp_path))
    first, second = (store.stored(spark, "source", "numbers", build) for _ in range(2))
    assert first.count() == second.count() == 5 and len(built) == 1
    assert all(str(tmp_path) in path for path in first.inputFiles())
    store.stored(spark, "other source", "numbers", build)
    assert len(built) == 2


def test_without_a_shared_folder_tables_are_computed_in_place(spark, monkeypatch):
    monkeypatch.setattr(store, "_FOLDERS", {})
    monkeypatch.setattr(store, "shared_folder", lambda _: None)
    assert store.stored(spark, "s", "numbers", lambda: spark.range(3)).inputFiles() == []
    with pytest.raises(RuntimeError, match="checkpoint"):
        store.new_path(spark, "x")


def test_date_profile(spark):
    table = spark.createDataFrame(
        [("2022-01-01",), ("2022-01-02",), ("2022-01-04",), (None,)], "d string"
    ).selectExpr("to_date(d) AS d")
    found = rows(profile.profile_dates(table))[0]
    days = {k: str(v) for k, v in found.items() if k not in ("column", "na_count")}
    assert days == {
        "minimum": "2022-01-01",
        "first_quartile": "2022-01-01",
        "median": "2022-01-02",
        "mean": "2022-01-02",
        "third_quartile": "2022-01-03",
        "maximum": "2022-01-04",
    }
    assert found["na_count"] == 1


@pytest.mark.parametrize(
    "values, mean", [((3e-9, 4e-9), 3.5e-9), ((1e12, 2.0), 500000000001.0), ((float("inf"), 2.0), float("inf"))]
)
def test_mean_of_any_size(spark, values, mean):
    table = spark.createDataFrame([(v,) for v in values], "x double")
    assert rows(profile.profile_numeric(table))[0]["mean"] == mean


def test_rows_that_differ_in_an_extra_column_are_no_duplicates(spark):
    table = trips(spark, trip("a"), trip("a"))
    numbered = table.selectExpr("*", "monotonically_increasing_id() AS start_station_id")
    assert rows(profile.has_duplicate_trips(numbered)) == [{"has_duplicates": False}]
    same = table.selectExpr("*", "1 AS start_station_id")
    assert rows(profile.has_duplicate_trips(same)) == [{"has_duplicates": True}]
