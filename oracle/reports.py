"""The DuckDB query that must equal each registered Spark query."""

from __future__ import annotations

from .base import SOURCE_COLUMNS, KEPT, over_complete, over_derived, over_rides, over_trips, rounded

N = "CAST(count(*) AS BIGINT)"
MINUTES = "CAST(sum(length_h) AS DOUBLE) / 100e0"
KM = "CAST(sum(distance_h) AS DOUBLE) / 100e0"
AVG_MINUTES = f"{MINUTES} / count(*)"
AVG_KM = f"{KM} / count(*)"
MONTH_NAME = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month AS INTEGER) * 3 - 2, 3)"
KNOWN_USER = "member_casual IN ('casual', 'member')"
BIKE_RANK = "CAST(list_position(['classic_bike', 'electric_bike', 'docked_bike'], rideable_type) AS INTEGER)"


def comma(n: str) -> str:
    return f"format('{{:,}}', {n})"


def short(n: str) -> str:
    def scaled(unit: str, suffix: str) -> str:
        return rf"regexp_replace(CAST({rounded(f'({n} / {unit})', 1)} AS VARCHAR), '\.0$', '') || '{suffix}'"

    return f"CASE WHEN {n} >= 1000000 THEN {scaled('1e6', 'M')} WHEN {n} >= 1000 THEN {scaled('1e3', 'K')} ELSE {comma(n)} END"


def percent_label(p: str) -> str:
    return f"CAST(CAST({p} AS BIGINT) AS VARCHAR) || '%'"


def share(count: str, within: str, digits: int = 0) -> str:
    over = f"OVER (PARTITION BY {within})" if within else "OVER ()"
    return rounded(f"({count} / CAST(sum({count}) {over} AS DOUBLE) * 100e0)", digits)


def grouped(keys: str, measures: str) -> str:
    return f"SELECT {keys}, {measures} FROM clean GROUP BY {keys}"


def legend(name: str, count: str) -> str:
    return f"upper(substr({name}, 1, 1)) || substr({name}, 2) || ' (' || {comma(count)} || ')'"


REPORTS: dict[str, str] = {}


def _rows() -> None:
    identity = "ride_id, started_at, ended_at"
    REPORTS["trips_by_month_file"] = over_trips(
        f"SELECT {MONTH_NAME} AS month_file, {N} AS rows FROM (SELECT strftime(started_at, '%m') AS month FROM trips) "
        "GROUP BY month"
    )
    REPORTS["trips_union_all"] = over_trips(f"SELECT {SOURCE_COLUMNS} FROM trips")
    REPORTS["trips_drop_na"] = over_complete(f"SELECT {SOURCE_COLUMNS} FROM complete")
    REPORTS["trips_calendar"] = over_derived(
        f"SELECT {identity}, date, month, day, year, day_of_week, day_index FROM derived"
    )
    REPORTS["trips_ride_length"] = over_derived(f"SELECT {identity}, ride_length FROM derived")
    REPORTS["trips_ride_distance"] = over_derived(
        f"SELECT {identity}, start_lat, start_lng, end_lat, end_lng, ride_distance FROM derived"
    )
    REPORTS["trips_ride_speed"] = over_derived(
        f"SELECT {identity}, ride_length, ride_distance, ride_speed FROM derived"
    )
    REPORTS["clean_rides"] = over_rides("SELECT * EXCLUDE (hour, length_h, distance_h) FROM clean")
    REPORTS["inspect_shortest"] = over_derived(
        "SELECT ride_length, ride_distance, started_at, ride_id FROM derived "
        "ORDER BY ride_length, ride_distance, started_at, ride_id LIMIT 6"
    )


def _summaries() -> None:
    def add(name: str, select: str, *ctes: str) -> None:
        REPORTS[name] = over_rides(select, *ctes)

    add(
        "rides_summary",
        f"SELECT member_casual, {N} AS total_rides FROM clean GROUP BY member_casual "
        f"UNION ALL SELECT 'Total', {N} FROM clean",
    )
    add(
        "user_rides",
        f"SELECT member_casual, total_rides, {share('total_rides', '', 2)} AS percent "
        f"FROM ({grouped('member_casual', f'{N} AS total_rides')})",
    )
    add("user_type_average", grouped("member_casual", f"{AVG_MINUTES} AS average_ride_time, {AVG_KM} AS average_distance"))
    add("total_monthly_rides", grouped("month", f"{N} AS rides"))
    add(
        "user_type_monthly_calc",
        grouped(
            "month, member_casual",
            f"{N} AS number_of_rides, {MINUTES} AS total_ride_time, {AVG_MINUTES} AS average_ride_time, "
            f"{AVG_KM} AS average_ride_distance",
        ),
    )
    REPORTS["appended_months"] = REPORTS["user_type_monthly_calc"]
    monthly_share = (
        f"SELECT *, CASE WHEN {KNOWN_USER} THEN {share('number_of_rides', 'month')} END AS percentage "
        f"FROM ({grouped('member_casual, month', f'{N} AS number_of_rides')})"
    )
    add("user_type_monthly_data", monthly_share)
    add("average_monthly_distance_user", grouped("month, member_casual", f"{AVG_KM} AS average_distance"))
    add(
        "month_breaks",
        "SELECT CAST(i AS INTEGER) AS position, a + i * ((b - a) / 11e0) AS month_break "
        "FROM (SELECT min(CAST(month AS INTEGER)) AS a, max(CAST(month AS INTEGER)) AS b FROM clean), range(12) AS r(i)",
    )
    weekday = "day_of_week, day_index"
    daily_share = (
        f"SELECT *, {share('number_of_rides', 'day_of_week')} AS percent "
        f"FROM ({grouped(f'member_casual, {weekday}', f'{N} AS number_of_rides')})"
    )
    add("total_daily_rides", daily_share)
    add(
        "daily_rides_user_type",
        grouped(
            f"member_casual, {weekday}",
            f"{N} AS number_of_rides, {MINUTES} AS total_ride_time, {AVG_MINUTES} AS average_ride_time, "
            f"{AVG_KM} AS average_distance",
        ),
    )
    add("average_daily_distance_user", grouped(f"{weekday}, member_casual", f"{AVG_KM} AS average_distance"))
    add(
        "total_rideable_type",
        grouped(
            "rideable_type",
            f"{N} AS number_of_rides, {MINUTES} AS total_ride_length, {AVG_MINUTES} AS average_ride_length, "
            f"{KM} AS total_distance, {AVG_KM} AS average_distance",
        ),
    )
    add("user_type_ride_total", grouped("rideable_type, member_casual", f"{N} AS number_of_rides"))
    timed = f"{N} AS number_of_rides, {MINUTES} AS total_ride_time, {AVG_MINUTES} AS average_ride_time"
    add(
        "user_type_ride_type",
        f"SELECT *, CASE WHEN {KNOWN_USER} THEN {share('number_of_rides', 'rideable_type')} END AS percentage, "
        f"{BIKE_RANK} AS type_rank FROM ({grouped('rideable_type, member_casual', timed)})",
    )
    add("user_ride_type_monthly", grouped("rideable_type, member_casual, month", timed))
    add("user_ride_type_day", grouped(f"rideable_type, member_casual, {weekday}", timed))
    add("rides_by_hour", grouped("hour", f"{N} AS count"))
    add("rides_by_hour_user_type", grouped("hour, member_casual", f"{N} AS count"))

    # Tables behind the charts
    month_number = f"CAST(month AS INTEGER) AS month_number, {MONTH_NAME} AS month_label"
    add(
        "chart_user_share",
        f"SELECT member_casual, total_rides, {share('total_rides', '', 2)} AS percent, "
        f"{percent_label(share('total_rides', ''))} AS slice_label, {legend('member_casual', 'total_rides')} AS legend_label "
        f"FROM ({grouped('member_casual', f'{N} AS total_rides')})",
    )
    add(
        "user_type_totals",
        f"SELECT casual_rides, member_rides, 'Casual (' || {comma('casual_rides')} || ')' AS casual_label, "
        f"'Member (' || {comma('member_rides')} || ')' AS member_label FROM (SELECT "
        "CAST(count(*) FILTER (member_casual = 'casual') AS BIGINT) AS casual_rides, "
        "CAST(count(*) FILTER (member_casual = 'member') AS BIGINT) AS member_rides FROM clean)",
    )
    add(
        "bike_type_share",
        f"SELECT replace(rideable_type, '_', ' ') AS rideable_type, {N} AS number_of_rides, "
        f"{MINUTES} AS total_ride_length, {AVG_MINUTES} AS average_ride_length, {KM} AS total_distance, "
        f"{AVG_KM} AS average_distance, {comma('count(*)')} AS count_label FROM clean "
        "WHERE rideable_type IN ('classic_bike', 'electric_bike', 'docked_bike') GROUP BY clean.rideable_type",
    )
    add(
        "chart_user_bike",
        f"SELECT *, replace(rideable_type, '_', ' ') AS bike_label, {short('number_of_rides')} AS count_label "
        f"FROM ({grouped('rideable_type, member_casual', f'{N} AS number_of_rides')})",
    )
    add(
        "bike_type_by_user",
        f"SELECT member_casual, rideable_type, {BIKE_RANK} AS type_rank, number_of_rides, "
        f"{share('number_of_rides', 'member_casual')} AS percent_of_user, {comma('number_of_rides')} AS count_label "
        f"FROM ({grouped('rideable_type, member_casual', f'{N} AS number_of_rides')})",
    )
    add(
        "monthly_rides",
        f"SELECT CAST(month AS INTEGER) AS month, {MONTH_NAME} AS month_label, rides, {short('rides')} AS rides_label "
        f"FROM ({grouped('month', f'{N} AS rides')})",
    )
    add("chart_monthly_user", f"SELECT *, {month_number}, {percent_label('percentage')} AS percent_label FROM ({monthly_share})")
    add("chart_daily_user", f"SELECT *, {percent_label('percent')} AS percent_label FROM ({daily_share})")
    add("chart_hourly", f"SELECT *, {short('count')} AS count_label FROM ({grouped('hour', f'{N} AS count')})")
    add(
        "chart_hourly_user",
        f"SELECT *, {short('count')} AS count_label FROM ({grouped('hour, member_casual', f'{N} AS count')})",
    )
    add(
        "chart_monthly_ride_time",
        f"SELECT *, {month_number} FROM ({grouped('month, member_casual', f'{AVG_MINUTES} AS average_ride_time')})",
    )
    add("chart_daily_ride_time", grouped(f"{weekday}, member_casual", f"{AVG_MINUTES} AS average_ride_time"))
    add(
        "chart_monthly_distance",
        f"SELECT *, {month_number} FROM ({grouped('month, member_casual', f'{AVG_KM} AS average_distance')})",
    )
    add("chart_daily_distance", grouped(f"{weekday}, member_casual", f"{AVG_KM} AS average_distance"))
    add(
        "label_counts",
        f"SELECT *, {short('number_of_rides')} AS short_label, {comma('number_of_rides')} AS comma_label "
        f"FROM ({grouped('rideable_type, member_casual, day_of_week', f'{N} AS number_of_rides')})",
    )


def _stations() -> None:
    for side, top, by_user, by_month, chart in (
        ("start", "top_start_station", "top_station_user_type", "top_station_user_type_mo", "chart_top_start"),
        ("end", "top_end_station", "top_end_station_user_type", "top_end_station_user_type_mo", "chart_top_end"),
    ):
        name = f"{side}_station_name"
        used = f"{name} IS NOT NULL AND {name} <> ''"
        top_sql = f"SELECT {name}, {N} AS count FROM clean WHERE {used} GROUP BY {name} ORDER BY count DESC, {name} LIMIT 10"
        REPORTS[top] = over_rides(top_sql)
        REPORTS[chart] = over_rides(
            f"SELECT *, CAST(row_number() OVER (ORDER BY count, {name}) AS INTEGER) AS display_order, "
            f"{comma('count')} AS count_label FROM ({top_sql})"
        )

        def split(by: str, limit: int) -> str:
            return (
                f"SELECT *, CAST(sum(count) OVER (PARTITION BY {name}) AS BIGINT) AS total_count FROM "
                f"(SELECT {name}, {by}, {N} AS count FROM clean WHERE {used} GROUP BY {name}, {by}) "
                f"ORDER BY total_count DESC, {name}, {by} LIMIT {limit}"
            )

        percent = f"{rounded('(count / CAST(total_count AS DOUBLE) * 100e0)', 0)} AS percent_user_type"
        REPORTS[by_user] = over_rides(f"SELECT *, {percent} FROM ({split('member_casual', 20)})")
        REPORTS[f"{chart}_user"] = over_rides(
            f"SELECT *, CAST(dense_rank() OVER (ORDER BY total_count, {name}) AS INTEGER) AS display_order, "
            f"{percent_label('percent_user_type')} AS percent_label "
            f"FROM (SELECT *, {percent} FROM ({split('member_casual', 20)}))"
        )
        REPORTS[by_month] = over_rides(split("member_casual, month", 240))

    REPORTS["top_n_with_ties"] = over_rides(
        "SELECT month, start_station_name, count FROM (SELECT *, rank() OVER (PARTITION BY month ORDER BY count DESC) AS r "
        f"FROM (SELECT month, start_station_name, {N} AS count FROM clean WHERE start_station_name <> '' "
        "GROUP BY month, start_station_name)) WHERE r <= 3"
    )
    REPORTS["station_cardinality"] = over_rides(
        " UNION ALL ".join(
            f"SELECT '{side}' AS side, CAST(count(DISTINCT {side}_station_name) AS BIGINT) AS station_names "
            f"FROM clean WHERE {side}_station_name <> ''"
            for side in ("start", "end")
        )
    )
    for side, report in (("start", "station_concentration"), ("end", "end_station_concentration")):
        REPORTS[report] = over_rides(
            f"SELECT member_casual, stations, rides, top_rides, {rounded('(top_rides / CAST(rides AS DOUBLE) * 100e0)', 2)} "
            f"AS top_percent FROM (SELECT member_casual, {N} AS stations, CAST(sum(n) AS BIGINT) AS rides, "
            "CAST(sum(n) FILTER (pos <= 10) AS BIGINT) AS top_rides FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY member_casual ORDER BY n DESC, {side}_station_name) AS pos FROM (SELECT member_casual, "
            f"{side}_station_name, count(*) AS n FROM clean WHERE {side}_station_name <> '' "
            f"GROUP BY member_casual, {side}_station_name)) GROUP BY member_casual)"
        )

    # The row limits of the map tables.
    for table, side, user, limit, lat, lng in (
        ("rides_started_station", "start", None, 554, "start_lat", "start_lng"),
        ("rides_ended_station", "end", None, 541, "end_lat", "end_lng"),
        ("member_rides_started", "start", "member", 504, "startlat", "startlng"),
        ("member_rides_ended", "end", "member", 497, "end_lat", "end_lng"),
        ("casual_rides_started", "start", "casual", 470, "startlat", "startlng"),
        ("casual_rides_ended", "end", "casual", 459, "end_lat", "end_lng"),
    ):
        name = f"{side}_station_name"
        key = "struct_pack(a := ride_length, b := ride_distance, c := started_at, d := ride_id, e := {0}_lat, f := {0}_lng)"
        keys = name if user is None else f"{name}, member_casual"
        where = f"{name} <> ''" + ("" if user is None else f" AND member_casual = '{user}'")
        body = (
            f"SELECT {keys}, CAST(count(DISTINCT ride_id) AS BIGINT) AS total_rides, "
            f"arg_min({side}_lat, {key.format(side)}) AS {lat}, arg_min({side}_lng, {key.format(side)}) AS {lng} "
            f"FROM clean WHERE {where} GROUP BY {keys}"
        )
        order = f"ORDER BY total_rides DESC, {name}"
        REPORTS[table] = over_rides(f"{body} {order} LIMIT {limit}")
        REPORTS[f"merged_{table}"] = REPORTS[table]
        REPORTS[f"{table}_short"] = over_rides(f"{body} {order} LIMIT 25")
        REPORTS[f"{table}_over_500"] = over_rides(f"SELECT * FROM ({body}) WHERE total_rides > 500")
        REPORTS[f"sink_{table}"] = over_rides(
            f"SELECT CAST(row_number() OVER ({order}) AS BIGINT) AS row_number, * FROM ({body} {order} LIMIT {limit})"
        )
    started = REPORTS["rides_started_station"]
    head, tail = started.rsplit("\nSELECT", 1)
    REPORTS["station_duplicates"] = (
        f"{head}\nSELECT count(*) > 0 AS has_duplicates FROM (SELECT 1 FROM (SELECT{tail}) "
        "GROUP BY start_station_name, total_rides, start_lat, start_lng HAVING count(*) > 1)"
    )


def _profiles() -> None:
    def numeric(table: str, columns: tuple[str, ...]) -> str:
        return " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", min({c}) AS minimum, quantile_cont({c}, 0.25) AS first_quartile, "
            f"quantile_cont({c}, 0.5) AS median, "
            f"CAST(printf('%.12e', favg({c})) AS DOUBLE) AS mean, "
            f"quantile_cont({c}, 0.75) AS third_quartile, max({c}) AS maximum, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS na_count FROM {table}"
            for c in columns
        )

    coordinates = ("start_lat", "start_lng", "end_lat", "end_lng")
    REPORTS["profile_numeric"] = over_trips(numeric("trips", coordinates))
    REPORTS["profile_rides"] = over_rides(
        numeric("clean", (*coordinates, "ride_length", "ride_distance", "ride_speed"))
    )
    day = "date_diff('day', DATE '1970-01-01', date)"

    def as_date(number: str) -> str:
        return f"CAST(DATE '1970-01-01' + CAST(floor({number}) AS INTEGER) AS DATE)"

    REPORTS["profile_dates"] = over_complete(
        f"SELECT 'date' AS \"column\", {as_date('min(d)')} AS minimum, "
        f"{as_date('quantile_cont(d, 0.25)')} AS first_quartile, {as_date('quantile_cont(d, 0.5)')} AS median, "
        f"{as_date('CAST(sum(d) AS DOUBLE) / count(d)')} AS mean, {as_date('quantile_cont(d, 0.75)')} AS third_quartile, "
        f"{as_date('max(d)')} AS maximum, CAST(count(*) - count(d) AS BIGINT) AS na_count "
        f"FROM (SELECT CAST({day} AS DOUBLE) AS d FROM (SELECT CAST(started_at AS DATE) AS date FROM complete))"
    )
    texts = ("ride_id", "rideable_type", "start_station_name", "end_station_name", "member_casual")
    REPORTS["profile_text"] = over_trips(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {N} AS length, 'character' AS class, 'character' AS mode, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS na_count, "
            f"CAST(count(*) FILTER ({c} = '') AS BIGINT) AS blank_count FROM trips"
            for c in texts
        )
    )
    shape = [(c, "double") for c in coordinates]
    shape = [
        ("ride_id", "string"),
        ("rideable_type", "string"),
        ("started_at", "timestamp_ntz"),
        ("ended_at", "timestamp_ntz"),
        ("start_station_name", "string"),
        ("end_station_name", "string"),
        *shape,
        ("member_casual", "string"),
    ]
    REPORTS["profile_shape"] = over_trips(
        " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS class, "
            f"CAST(count({c}) AS BIGINT) AS filled_rows, CAST({len(shape)} AS INTEGER) AS column_count FROM trips"
            for i, (c, t) in enumerate(shape, start=1)
        )
    )

    def fails(rule: str) -> str:
        return f"CAST(count(*) FILTER (NOT ({rule})) AS BIGINT)"

    REPORTS["cleaning_audit"] = over_derived(
        "SELECT CAST((SELECT count(*) FROM trips) AS BIGINT) AS rows_read, "
        "CAST((SELECT count(*) FROM trips) - count(*) AS BIGINT) AS rows_incomplete, "
        f"{fails('ride_length > 1')} AS rows_too_short, {fails('ride_distance > 0')} AS rows_without_distance, "
        + fails("start_station_name NOT IN ('Base - 2132 W Hubbard Warehouse', 'Base - 2132 W Hubbard', 'Charge')")
        + " AS rows_maintenance_start, "
        + fails(
            "end_station_name NOT IN ('Hubbard Bike-checking (LBS-WH-TEST)', 'Base - 2132 W Hubbard Warehouse')"
        )
        + f" AS rows_maintenance_end, CAST(count(*) FILTER ({KEPT}) AS BIGINT) AS rows_clean FROM derived"
    )
    lost_name, lost_place = "day(started_at) % 4 = 0", "(day(started_at) % 5 < 2 OR end_lat IS NULL)"
    REPORTS["missing_value_rule"] = over_trips(
        f"SELECT count(*) AS rows, count(*) FILTER ({lost_name}) AS missing_names, "
        "count(*) FILTER (day(started_at) % 4 IN (1, 2) OR (day(started_at) % 4 = 3 AND start_station_name = '')) AS blank_names, "
        f"count(*) FILTER ({lost_place}) AS missing_latitudes, "
        f"count(*) FILTER (NOT ({lost_name}) AND NOT {lost_place} AND end_lng IS NOT NULL) AS complete_rows FROM trips"
    )
    REPORTS["timestamp_forms"] = over_trips(
        "SELECT CAST(day(started_at) % 6 AS INTEGER) AS form, count(*) AS rows, "
        "count(*) FILTER (day(started_at) % 6 < 4) AS read, count(*) FILTER (day(started_at) % 6 >= 4) AS rejected "
        "FROM trips WHERE started_at IS NOT NULL GROUP BY ALL"
    )
    REPORTS["has_duplicate_rows"] = over_complete(
        "SELECT count(*) > 0 AS has_duplicates FROM "
        f"(SELECT 1 FROM complete GROUP BY {SOURCE_COLUMNS} HAVING count(*) > 1)"
    )


_rows()
_summaries()
_stations()
_profiles()
