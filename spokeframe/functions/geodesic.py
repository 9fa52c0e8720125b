"""Length of the shortest path between two points on the WGS84 ellipsoid.

Spark has no ellipsoidal distance, and the iterative solution written as column
expressions is copied into every filter that reads its result, so it runs as an
Arrow function on numpy arrays. The method is T. Vincenty's inverse solution
(Survey Review XXIII/176, 1975). It does not settle for nearly antipodal points;
those are solved by bisecting the departure azimuth as described by C. F. F.
Karney, "Algorithms for geodesics" (J. Geodesy 87, 2013), section 4.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Workers receive this helper by value: no package has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The WGS84 ellipsoid.
EQUATOR_RADIUS_M = 6378137.0
FLATTENING = 1 / 298.257223563
POLE_RADIUS_M = EQUATOR_RADIUS_M * (1 - FLATTENING)

MAX_STEPS = 24
SETTLED_RAD = 1e-13
BISECTIONS = 60


def _longitude_excess(sin_alpha, cos_sq_alpha, sigma, sin_sigma, cos_sigma, cos_2sm):
    """How much further the longitude runs on the sphere than on the ellipsoid."""
    c = FLATTENING / 16 * cos_sq_alpha * (4 + FLATTENING * (4 - 3 * cos_sq_alpha))
    inner = cos_2sm + c * cos_sigma * (2 * cos_2sm**2 - 1)
    return (1 - c) * FLATTENING * sin_alpha * (sigma + c * sin_sigma * inner)


def _arc_metres(cos_sq_alpha, sigma, sin_sigma, cos_sigma, cos_2sm):
    """Length on the ellipsoid of the arc ``sigma`` of the auxiliary sphere."""
    u_sq = cos_sq_alpha * (EQUATOR_RADIUS_M**2 - POLE_RADIUS_M**2) / POLE_RADIUS_M**2
    a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
    b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
    tail = b / 6 * cos_2sm * (4 * sin_sigma**2 - 3) * (4 * cos_2sm**2 - 3)
    correction = b * sin_sigma * (cos_2sm + b / 4 * (cos_sigma * (2 * cos_2sm**2 - 1) - tail))
    return POLE_RADIUS_M * a * (sigma - correction)


def _by_iteration(u1, u2, lon):
    """Vincenty's iteration; returns metres and which rows have settled."""
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = lon
    step = np.zeros_like(lon)
    for _ in range(MAX_STEPS):
        sin_lam, cos_lam = np.sin(lam), np.cos(lam)
        sin_sigma = np.hypot(cu2 * sin_lam, cu1 * su2 - su1 * cu2 * cos_lam)
        cos_sigma = su1 * su2 + cu1 * cu2 * cos_lam
        sigma = np.arctan2(sin_sigma, cos_sigma)
        same_point = sin_sigma == 0
        sin_alpha = np.where(same_point, 0.0, cu1 * cu2 * sin_lam / np.where(same_point, 1.0, sin_sigma))
        cos_sq_alpha = 1 - sin_alpha**2
        on_equator = cos_sq_alpha <= 1e-15
        cos_2sm = np.where(on_equator, 0.0, cos_sigma - 2 * su1 * su2 / np.where(on_equator, 1.0, cos_sq_alpha))
        new = lon + _longitude_excess(sin_alpha, cos_sq_alpha, sigma, sin_sigma, cos_sigma, cos_2sm)
        step, lam = np.abs(new - lam), new
        if not np.any(step > SETTLED_RAD):
            break
    metres = _arc_metres(cos_sq_alpha, sigma, sin_sigma, cos_sigma, cos_2sm)
    return metres, (step <= SETTLED_RAD * 10) & (np.abs(lam) <= np.pi)


def _by_bisection(u1, u2, lon):
    """Bisect the departure azimuth until the arrival longitude fits."""
    # Symmetry: start at the point nearer a pole, placed in the southern half.
    lon = np.abs(lon)
    swap = np.abs(u1) < np.abs(u2)
    u1, u2 = np.where(swap, u2, u1), np.where(swap, u1, u2)
    u1, u2 = -np.abs(u1), np.where(u1 > 0, -u2, u2)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)

    low, high = np.zeros_like(lon), np.full_like(lon, np.pi)
    for _ in range(BISECTIONS):
        azimuth = (low + high) / 2
        sin_alpha = np.sin(azimuth) * cu1
        cos_az1 = np.cos(azimuth)
        cos_az2 = np.sqrt(np.maximum(0.0, (cos_az1 * cu1) ** 2 + cu2**2 - cu1**2)) / cu2
        sigma1 = np.arctan2(su1, cos_az1 * cu1)
        sigma2 = np.arctan2(su2, cos_az2 * cu2)
        omega1 = np.arctan2(sin_alpha * np.sin(sigma1), np.cos(sigma1))
        omega2 = np.arctan2(sin_alpha * np.sin(sigma2), np.cos(sigma2))
        sigma = sigma2 - sigma1
        sin_sigma, cos_sigma, cos_2sm = np.sin(sigma), np.cos(sigma), np.cos(sigma1 + sigma2)
        cos_sq_alpha = 1 - sin_alpha**2
        excess = _longitude_excess(sin_alpha, cos_sq_alpha, sigma, sin_sigma, cos_sigma, cos_2sm)
        short = (omega2 - omega1) - excess < lon
        low, high = np.where(short, azimuth, low), np.where(short, high, azimuth)
    return _arc_metres(cos_sq_alpha, sigma, sin_sigma, cos_sigma, cos_2sm)


def metres_between(lng1, lat1, lng2, lat2) -> np.ndarray:
    """Geodesic length in metres for arrays of degrees.

    NaN for a missing coordinate and for a latitude beyond a pole.
    """
    lat1, lat2 = (np.where(np.abs(lat) <= 90.0, lat, np.nan) for lat in (lat1, lat2))
    u1 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat1)))
    u2 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat2)))
    lon = np.radians((np.asarray(lng2, dtype=float) - lng1 + 180.0) % 360.0 - 180.0)
    with np.errstate(invalid="ignore"):
        metres, settled = _by_iteration(u1, u2, lon)
        hard = ~settled & ~np.isnan(metres)
        if hard.any():
            metres[hard] = _by_bisection(u1[hard], u2[hard], lon[hard])
    return metres


def _kilometres(lng1: pa.Array, lat1: pa.Array, lng2: pa.Array, lat2: pa.Array) -> pa.Array:
    degrees = [a.to_numpy(zero_copy_only=False) for a in (lng1, lat1, lng2, lat2)]
    km = metres_between(*degrees) / 1000
    # A measured length does not fall on a rounding tie.
    return pa.array(np.rint(km * 100) / 100, type=pa.float64(), from_pandas=True)


def geodesic_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Geodesic kilometres, two decimals; NULL when a coordinate is NULL.

    Marked non-deterministic only so that a later filter on the result is not
    moved below it, which would evaluate the function a second time. Put cheap
    filters before it.
    """
    kilometres = F.arrow_udf(_kilometres, "double").asNondeterministic()
    return kilometres(lng1, lat1, lng2, lat2)
