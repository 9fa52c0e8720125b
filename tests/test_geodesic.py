from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spokeframe.functions.geodesic import geodesic_km, metres_between


def metres(lng1, lat1, lng2, lat2) -> float:
    return float(metres_between(*[np.array([float(v)]) for v in (lng1, lat1, lng2, lat2)])[0])


def dms(degrees: int, minutes: int, seconds: float) -> float:
    return degrees + minutes / 60 + seconds / 3600


@pytest.mark.parametrize(
    "points, expected, tolerance",
    [
        ((0, 0, 1, 0), 111319.4908, 1e-4),
        ((0, 0, 0, 1), 110574.3886, 1e-4),
        # Flinders Peak to Buninyong, the published test line of the iteration
        (
            (
                dms(144, 25, 29.52440),
                -dms(37, 57, 3.72030),
                dms(143, 55, 35.38390),
                -dms(37, 39, 10.15610),
            ),
            54972.271,
            5e-4,
        ),
        # Nearly antipodal points, where the iteration does not settle
        ((0, -30, 179.8, 29.9), 19989832.82761, 1e-3),
        ((0, 0, 179.5, 0.5), 19936288.578965, 1e-3),
        ((0, 0, 180, 0), 20003931.458625, 1e-3),
        ((0, 90, 77, -90), 20003931.458625, 1e-3),
        # Across the date line
        ((179.5, 0, -179.5, 0), 111319.4908, 1e-4),
    ],
)
def test_published_lines(points, expected, tolerance):
    assert metres(*points) == pytest.approx(expected, abs=tolerance)


def test_same_point_and_missing_values():
    assert metres(-87.6, 41.9, -87.6, 41.9) == 0.0
    assert np.isnan(metres(np.nan, 41.9, -87.6, 41.9))
    assert np.isnan(metres(0, 95, 0, 0))


coordinate = st.tuples(st.floats(-180, 180), st.floats(-90, 90))


@settings(max_examples=300, deadline=None)
@given(coordinate, coordinate)
def test_symmetric_and_bounded(a, b):
    there, back = metres(*a, *b), metres(*b, *a)
    assert there == pytest.approx(back, abs=1e-5)
    assert 0 <= there <= 20003931.4587


def test_column_rounds_and_keeps_nulls(spark):
    table = spark.createDataFrame(
        [(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, None, 0.0)], "a double, b double, c double, d double"
    )
    values = [r[0] for r in table.select(geodesic_km(*[F.col(c) for c in "abcd"])).collect()]
    assert values == [111.32, None]
