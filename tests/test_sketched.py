"""Two-scan quantiles: exact for any distribution, and the number of scans."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from spokeframe.operators import profile, quantiles, sketched

PROBS = (0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0)
INF = float("inf")


def uneven(n: int) -> dict[str, list]:
    rng = random.Random(n)
    return {
        "hot": [7.0 if i % 3 == 0 else rng.gauss(7, 3) for i in range(n)],
        "tail": [rng.expovariate(1) ** 6 for _ in range(n)],
        "three scales": [rng.random() for _ in range(n - 3)] + [1e9, 1e18, 1e300],
        "rising": [float(i) for i in range(n)],
        "few": [float(rng.randrange(3)) for _ in range(n)],
        "infinite": [rng.choice([-INF, INF, 0.0, -0.0, 5e-324, rng.random()]) for _ in range(n)],
        "holes": [None if i % 2 else rng.random() for i in range(n)],
        "none": [None] * n,
        "one": [2.5] + [None] * (n - 1),
    }


def table(spark, columns, parts=6):
    names = list(columns)
    made = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{c}` double" for c in names))
    return made.repartition(parts)


def assert_exact(found, columns):
    for column, values in zip(found, columns.values(), strict=True):
        present = sorted(v for v in values if v is not None)
        assert column["n"] == len(present)
        for p in PROBS if present else ():
            position = (len(present) - 1) * p
            below, above = present[int(np.floor(position))], present[int(np.ceil(position))]
            share = position - np.floor(position)
            want = below if below == above else (1 - share) * below + share * above
            assert column["quantiles"][p] == want or np.isnan(want)
        if not present:
            assert column["quantiles"] == {} and column["low"] is None


@pytest.fixture()
def stores(tmp_path):
    """A keep that writes, and what it wrote."""
    written = []

    def keep(made):
        path = str(tmp_path / f"kept-{len(written)}")
        made.write.parquet(path)
        written.append(path)
        return made.sparkSession.read.schema(made.schema).parquet(path)

    return keep, written


@pytest.mark.parametrize("n", [5, 1500, 30_000])
def test_quantiles_are_exact_in_two_scans(spark, stores, n):
    keep, written = stores
    columns = uneven(n)
    found = sketched.column_quantiles(table(spark, columns), PROBS, keep=keep)
    assert_exact(found, columns)
    assert len(written) == 1  # the scan of the sketch, and one whose counts were stored


def test_only_a_few_rows_are_counted_by_value(spark, stores):
    keep, written = stores
    columns = {"rising": [float(i) for i in range(60_000)]}
    assert_exact(sketched.column_quantiles(table(spark, columns), PROBS, keep=keep), columns)
    inside = spark.read.parquet(written[0]).where("value IS NOT NULL").count()
    assert inside <= 60_000 * 3 * sketched.MARGIN * len(PROBS)


def test_a_bracket_that_misses_is_found_out(spark, stores, monkeypatch):
    """Sketches that lie: all brackets beside the rank, to either side."""
    keep, written = stores
    columns = {"rising": [float(i) for i in range(3_000)], "equal": [1.0] * 3_000, "falling": [-float(i) for i in range(3_000)]}
    real = sketched.summaries

    def lying(shift):
        def made(*args):
            row = real(*args)
            names = row.columns
            shifted = [F.col(c).withField("bounds", F.transform(F.col(c)["bounds"], lambda b: b + shift)) for c in names]
            return row.select(*[s.alias(c) for s, c in zip(shifted, names, strict=True)])

        return made

    monkeypatch.setattr(sketched, "FEW", 100)
    for shift in (400.0, -400.0):
        monkeypatch.setattr(sketched, "summaries", lying(shift))
        assert_exact(sketched.column_quantiles(table(spark, columns), PROBS, keep=keep), columns)
    assert 2 < len(written) <= 8


def test_many_values_inside_are_narrowed_in_what_was_stored(spark, stores, monkeypatch):
    keep, written = stores
    monkeypatch.setattr(quantiles, "MOST_LEFT", 50)
    columns = uneven(20_000)
    assert_exact(sketched.column_quantiles(table(spark, columns), PROBS, keep=keep), columns)
    assert len(written) == 1


def test_profile_scans_the_table_twice(spark, tmp_path, stores):
    """Rows read from the table's own files, counted as they pass."""
    keep, _ = stores
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    columns = {"x": [float(i % 977) for i in range(20_000)], "y": [float(i) for i in range(20_000)]}
    seen = table(spark, columns).mapInArrow(count, "x double, y double")
    found = rows(profile.profile_numeric(seen, keep=keep))
    assert passed.value == 2 * 20_000
    assert [r["median"] for r in found] == [np.median(columns["x"]), np.median(columns["y"])]


def test_profile_without_rows_or_columns(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert rows(profile.profile_numeric(empty)) == [
        {"column": "x", **dict.fromkeys(("minimum", "first_quartile", "median", "mean", "third_quartile", "maximum")), "na_count": 0}
    ]
    assert profile.profile_numeric(empty.select("s")).count() == 0
