"""DuckDB SQL for the trip view, the geodesic and the cleaned rides.

Written from FIXTURES.md, independently of the Spark code: the distance is the
plain six-step Vincenty iteration, one common table expression per step.
"""

from __future__ import annotations

GEODESIC_STEPS = 6

TRIPS = """
h0 AS (
  SELECT *, l_orderkey AS k, l_partkey AS p, l_suppkey AS s, l_linenumber AS n,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS c
  FROM lineitem),
h1 AS (
  SELECT *, least(k % 60, (s * 7 + n) % 60) AS st, least(p % 60, (k * 3 + n) % 60) AS et,
         (c * 31 + k * 7 + n) % 86400 AS off,
         CASE WHEN c % 97 = 0 THEN 60 WHEN c % 89 = 0 THEN 0 ELSE (c % 5400) - 30 END AS dur
  FROM h0),
h2 AS (
  SELECT *, (4164000 + st * 700 + c % 100) / 1e5 AS slat,
         (-8785000 + (st * 1300) % 33000 + c % 50) / 1e5 AS slng
  FROM h1),
trips AS (
  SELECT concat('R', k, '-', n) AS ride_id,
    CASE WHEN l_returnflag = 'N' THEN 'electric_bike'
         WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'docked_bike'
         ELSE 'classic_bike' END AS rideable_type,
    l_shipdate + to_seconds(off) AS started_at,
    l_shipdate + to_seconds(off + dur) AS ended_at,
    CASE st WHEN 7 THEN '' WHEN 11 THEN 'Base - 2132 W Hubbard Warehouse' WHEN 13 THEN 'Charge'
         WHEN 17 THEN 'Base - 2132 W Hubbard' ELSE concat('Station ', st) END AS start_station_name,
    CASE et WHEN 7 THEN '' WHEN 11 THEN 'Base - 2132 W Hubbard Warehouse' WHEN 13 THEN 'Charge'
         WHEN 19 THEN 'Hubbard Bike-checking (LBS-WH-TEST)' ELSE concat('Station ', et) END AS end_station_name,
    slat AS start_lat, slng AS start_lng,
    CASE WHEN p % 211 = 0 THEN NULL WHEN c % 53 = 0 THEN slat
         ELSE (4164000 + et * 700 + c % 70) / 1e5 END AS end_lat,
    CASE WHEN p % 211 = 0 THEN NULL WHEN c % 53 = 0 THEN slng
         ELSE (-8785000 + (et * 1300) % 33000 + c % 40) / 1e5 END AS end_lng,
    CASE l_linestatus WHEN 'F' THEN 'casual' ELSE 'member' END AS member_casual
  FROM h2)"""

SOURCE_COLUMNS = (
    "ride_id, rideable_type, started_at, ended_at, start_station_name, end_station_name, "
    "start_lat, start_lng, end_lat, end_lng, member_casual"
)

COMPLETE = """
complete AS (
  SELECT * FROM trips
  WHERE ride_id IS NOT NULL AND rideable_type IS NOT NULL AND started_at IS NOT NULL
    AND ended_at IS NOT NULL AND start_station_name IS NOT NULL AND end_station_name IS NOT NULL
    AND start_lat IS NOT NULL AND start_lng IS NOT NULL AND end_lat IS NOT NULL
    AND end_lng IS NOT NULL AND member_casual IS NOT NULL)"""

_A = "6378137e0"
_F = "(1e0 / 298.257223563e0)"
_B = f"({_A} * (1e0 - {_F}))"


def rounded(x: str, digits: int) -> str:
    """Nearest value with ``digits`` places, ties to even, as SQL."""
    if digits == 0:
        return f"round_even({x}, 0)"
    s = f"1e{digits}"
    low, high = f"floor(({x}) * {s}) / {s}", f"ceil(({x}) * {s}) / {s}"
    down, up = f"(({x}) - {low})", f"({high} - ({x}))"
    even = f"CAST(floor(({x}) * {s}) AS BIGINT) % 2 = 0"
    return f"(CASE WHEN {down} < {up} OR ({down} = {up} AND {even}) THEN {low} ELSE {high} END)"


def _geodesic(source: str) -> str:
    """CTEs g0 … gd: the rows of ``source`` with ``metres``."""
    parts = [
        f"""g0 AS (SELECT *, atan((1e0 - {_F}) * tan(radians(start_lat))) AS u1,
  atan((1e0 - {_F}) * tan(radians(end_lat))) AS u2, radians(end_lng - start_lng) AS lon FROM {source})""",
        """gl AS (SELECT *, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2, lon AS lam0 FROM g0)""",
    ]
    previous = "gl"
    for i in range(GEODESIC_STEPS):
        j = i + 1
        parts += [
            f"""ga{j} AS (SELECT *, sqrt((cu2 * sin(lam{i})) ** 2 + (cu1 * su2 - su1 * cu2 * cos(lam{i})) ** 2) AS ss{j},
  su1 * su2 + cu1 * cu2 * cos(lam{i}) AS cs{j} FROM {previous})""",
            f"""gb{j} AS (SELECT *, atan2(ss{j}, cs{j}) AS sg{j},
  CASE WHEN ss{j} = 0 THEN 0e0 ELSE cu1 * cu2 * sin(lam{i}) / ss{j} END AS sa{j} FROM ga{j})""",
            f"""gc{j} AS (SELECT *, 1e0 - sa{j} ** 2 AS q{j} FROM gb{j})""",
            f"""gd{j} AS (SELECT *, CASE WHEN q{j} = 0 THEN 0e0 ELSE cs{j} - 2e0 * su1 * su2 / q{j} END AS cm{j},
  {_F} / 16e0 * q{j} * (4e0 + {_F} * (4e0 - 3e0 * q{j})) AS cc{j} FROM gc{j})""",
            f"""ge{j} AS (SELECT *, lon + (1e0 - cc{j}) * {_F} * sa{j} * (sg{j} + cc{j} * ss{j} *
  (cm{j} + cc{j} * cs{j} * (2e0 * cm{j} ** 2 - 1e0))) AS lam{j} FROM gd{j})""",
        ]
        previous = f"ge{j}"
    n = GEODESIC_STEPS
    parts += [
        f"""gu AS (SELECT *, q{n} * ({_A} ** 2 - {_B} ** 2) / {_B} ** 2 AS uu FROM {previous})""",
        """gv AS (SELECT *, 1e0 + uu / 16384e0 * (4096e0 + uu * (-768e0 + uu * (320e0 - 175e0 * uu))) AS va,
  uu / 1024e0 * (256e0 + uu * (-128e0 + uu * (74e0 - 47e0 * uu))) AS vb FROM gu)""",
        f"""gw AS (SELECT *, {_B} * va * (sg{n} - vb * ss{n} * (cm{n} + vb / 4e0 * (cs{n} * (2e0 * cm{n} ** 2 - 1e0)
  - vb / 6e0 * cm{n} * (4e0 * ss{n} ** 2 - 3e0) * (4e0 * cm{n} ** 2 - 3e0)))) AS metres FROM gv)""",
    ]
    return ",\n".join(parts)


def _derived(source: str) -> str:
    return f"""{_geodesic(source)},
d0 AS (SELECT *, date_diff('microsecond', started_at, ended_at) / 1e6 / 60e0 AS minutes, metres / 1000e0 AS km FROM gw),
d1 AS (SELECT *, {rounded("minutes", 2)} AS ride_length, {rounded("km", 2)} AS ride_distance FROM d0),
d2 AS (SELECT *, ride_distance / nullif(ride_length / 60e0, 0) AS kmh FROM d1),
derived AS (
  SELECT {SOURCE_COLUMNS},
    CAST(started_at AS DATE) AS date, strftime(started_at, '%m') AS month, strftime(started_at, '%d') AS day,
    strftime(started_at, '%Y') AS year, dayname(started_at) AS day_of_week,
    CAST(dayofweek(started_at) + 1 AS INTEGER) AS day_index,
    CAST(hour(started_at) AS INTEGER) AS hour,
    ride_length, ride_distance, {rounded("kmh", 2)} AS ride_speed,
    CAST(round(ride_length * 100) AS BIGINT) AS length_h, CAST(round(ride_distance * 100) AS BIGINT) AS distance_h
  FROM d2)"""


KEPT = """ride_length > 1 AND ride_distance > 0
    AND start_station_name NOT IN ('Base - 2132 W Hubbard Warehouse', 'Base - 2132 W Hubbard', 'Charge')
    AND end_station_name <> 'Hubbard Bike-checking (LBS-WH-TEST)'
    AND end_station_name <> 'Base - 2132 W Hubbard Warehouse'"""


def over_trips(select: str) -> str:
    return f"WITH {TRIPS}\n{select}"


def over_complete(select: str) -> str:
    return f"WITH {TRIPS},{COMPLETE}\n{select}"


def over_derived(select: str, source: str = "complete") -> str:
    return f"WITH {TRIPS},{COMPLETE},\n{_derived(source)}\n{select}"


def over_rides(select: str, *ctes: str) -> str:
    """A query over the cleaned rides, table ``clean``, after further CTEs."""
    clean = f"clean AS MATERIALIZED (SELECT * FROM derived WHERE {KEPT})"
    more = "".join(f",\n{c}" for c in ctes)
    return f"WITH {TRIPS},{COMPLETE},\n{_derived('complete')},\n{clean}{more}\n{select}"
