"""The registered queries again as SQL for an independent engine."""

from __future__ import annotations

import re

from haltline.operators.validation import RULE_FAMILIES
from haltline.plans.benchfeed import FAULTY_SQL, FEED_SQL
from haltline.plans.catalog import BOARD_SIZE, DETAIL_PART, PAGE, THIN_TARGET
from haltline.plans.requests import REQUEST_SQL
from haltline.schema import ROUTE_COLUMNS, STOP_COLUMNS, TRIP_COLUMNS, Timetable


def _fill(sql: str, prefix: str = "") -> str:
    return re.sub(r"\{(\w+)\}", lambda found: f"{prefix}{found.group(1)}", sql)


# Named subqueries: f_ the feed, x_ the feed with faults, t_ the tables, q_ the requests.
CTES: dict[str, str] = {
    **{f"f_{name}": _fill(sql) for name, sql in FEED_SQL.items()},
    **{f"x_{name}": _fill(sql, "f_") for name, sql in FAULTY_SQL.items()},
    **{f"q_{name}": _fill(sql) for name, sql in REQUEST_SQL.items()},
}


def _tables(source: str, target: str) -> dict[str, str]:
    return {
        f"{target}agencies": f"""SELECT agency_id, agency_name AS name, agency_url AS url,
            agency_timezone AS timezone FROM {source}agency""",
        f"{target}stops": f"""SELECT stop_id, nullif(stop_code, '') AS code, stop_name AS name,
            stop_lat AS latitude, stop_lon AS longitude, location_type,
            nullif(parent_station, '') AS parent_stop_id,
            nullif(platform_code, '') AS platform_code FROM {source}stops""",
        f"{target}routes": f"""SELECT route_id, nullif(agency_id, '') AS agency_id,
            nullif(route_short_name, '') AS short_name, nullif(route_long_name, '') AS long_name,
            route_type, nullif(route_color, '') AS color,
            nullif(route_text_color, '') AS text_color FROM {source}routes""",
        f"{target}trips": f"""SELECT trip_id, route_id, service_id,
            nullif(trip_headsign, '') AS headsign, nullif(trip_short_name, '') AS short_name,
            direction_id, nullif(shape_id, '') AS shape_id FROM {source}trips""",
        f"{target}stop_times": f"""SELECT trip_id, stop_id, stop_sequence,
            arrival_time AS arrival_seconds, departure_time AS departure_seconds,
            nullif(stop_headsign, '') AS stop_headsign, pickup_type, drop_off_type, timepoint
            FROM {source}stop_times""",
        f"{target}service_calendars": f"""SELECT service_id, sunday, monday, tuesday, wednesday,
            thursday, friday, saturday, start_date, end_date FROM {source}calendar""",
        f"{target}service_exceptions": f"""SELECT service_id, date AS service_date, exception_type
            FROM {source}calendar_dates""",
        f"{target}shape_points": f"""SELECT shape_id, shape_pt_sequence AS sequence,
            shape_pt_lat AS latitude, shape_pt_lon AS longitude,
            shape_dist_traveled AS distance_traveled FROM {source}shapes""",
        f"{target}transfers": f"""SELECT from_stop_id, to_stop_id, from_route_id, to_route_id,
            from_trip_id, to_trip_id, transfer_type, min_transfer_time FROM {source}transfers""",
        f"{target}feed_info": f"""SELECT feed_publisher_name AS publisher_name,
            feed_publisher_url AS publisher_url, feed_lang, nullif(default_lang, '') AS default_lang,
            feed_start_date AS start_date, feed_end_date AS end_date,
            nullif(feed_version, '') AS source_version,
            nullif(feed_contact_email, '') AS contact_email,
            nullif(feed_contact_url, '') AS contact_url FROM {source}feed_info""",
    }


CTES |= _tables("f_", "t_") | _tables("x_", "u_")

CTES["c_active"] = """
SELECT DISTINCT service_id, service_date FROM (
  SELECT service_id, CAST(d AS DATE) AS service_date
  FROM (SELECT *, unnest(generate_series(CAST(start_date AS TIMESTAMP),
                CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS d
        FROM t_service_calendars WHERE start_date <= end_date) AS days
  WHERE CASE dayofweek(d) WHEN 0 THEN sunday WHEN 1 THEN monday WHEN 2 THEN tuesday
    WHEN 3 THEN wednesday WHEN 4 THEN thursday WHEN 5 THEN friday ELSE saturday END = 1
    AND NOT EXISTS (SELECT 1 FROM t_service_exceptions AS e
      WHERE e.service_id = days.service_id AND e.service_date = CAST(days.d AS DATE)
        AND e.exception_type = 2)
  UNION ALL
  SELECT service_id, service_date FROM t_service_exceptions WHERE exception_type = 1
) AS runs"""

CTES["v_stops"] = """SELECT stop_id, code, name, latitude, longitude,
  coalesce(location_type, 0) AS location_type, parent_stop_id, platform_code FROM t_stops"""

_HAVERSINE = """12742000e0 * asin(sqrt(
    pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))
    * pow(sin(radians({lon2} - {lon1}) / 2), 2)))"""


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return _HAVERSINE.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


def _text(seconds: str) -> str:
    return f"""CASE WHEN {seconds} IS NOT NULL THEN
      lpad(CAST({seconds} // 3600 AS VARCHAR), 2, '0') || ':' ||
      lpad(CAST({seconds} % 3600 // 60 AS VARCHAR), 2, '0') || ':' ||
      lpad(CAST({seconds} % 60 AS VARCHAR), 2, '0') END"""


def _columns(names, alias: str) -> str:
    return ", ".join(f"{alias}.{name}" for name in names)


CTES["c_boardable"] = """
SELECT st.stop_id, st.trip_id, st.stop_sequence, st.departure_seconds,
  t.service_id, t.route_id, coalesce(st.stop_headsign, t.headsign) AS headsign,
  coalesce(st.pickup_type, 0) AS pickup_type, coalesce(st.drop_off_type, 0) AS drop_off_type,
  coalesce(st.timepoint, 1) AS timepoint,
  r.short_name AS route_short_name, r.long_name AS route_long_name
FROM t_stop_times AS st JOIN t_trips AS t ON t.trip_id = st.trip_id
JOIN t_routes AS r ON r.route_id = t.route_id
WHERE st.departure_seconds IS NOT NULL AND coalesce(st.pickup_type, 0) <> 1"""

_DEPARTURE = f"""trip_id, route_id, route_short_name, route_long_name, headsign, stop_sequence,
  strftime(service_date, '%Y-%m-%d') AS service_date,
  {_text("departure_seconds")} AS scheduled_departure,
  departure_seconds AS scheduled_departure_seconds, pickup_type, drop_off_type, timepoint"""

# Groups: parent components, their mean positions and names, links by name, components again.
CTES["g_edges"] = """
SELECT s.stop_id AS a, p.stop_id AS b FROM t_stops AS s JOIN t_stops AS p
  ON p.stop_id = s.parent_stop_id
UNION SELECT p.stop_id, s.stop_id FROM t_stops AS s JOIN t_stops AS p
  ON p.stop_id = s.parent_stop_id"""
CTES["g_reach"] = """
SELECT stop_id AS a, stop_id AS b FROM t_stops
UNION SELECT g_reach.a, g_edges.b FROM g_reach JOIN g_edges ON g_edges.a = g_reach.b"""
CTES["g_parent"] = "SELECT a AS stop_id, min(b) AS label FROM g_reach GROUP BY a"
CTES["g_usable"] = """
SELECT stop_id, latitude, longitude FROM t_stops
WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)"""
CTES["g_points"] = """
SELECT n.label, n.name, p.lat, p.lon, floor(p.lat / 15e-4) AS cy, floor(p.lon / 25e-4) AS cx
FROM (SELECT DISTINCT label, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS name
      FROM t_stops JOIN g_parent USING (stop_id)) AS n
JOIN (SELECT label, avg(latitude) AS lat, avg(longitude) AS lon
      FROM g_usable JOIN g_parent USING (stop_id) GROUP BY label) AS p USING (label)"""
CTES["g_links"] = f"""
SELECT DISTINCT a.label AS a, b.label AS b
FROM g_points AS a JOIN g_points AS b ON a.name = b.name AND a.label <> b.label
  AND abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1
  AND {_haversine("a.lat", "a.lon", "b.lat", "b.lon")} <= 150"""
CTES["g_reach2"] = """
SELECT DISTINCT label AS a, label AS b FROM g_parent
UNION SELECT g_reach2.a, g_links.b FROM g_reach2 JOIN g_links ON g_links.a = g_reach2.b"""
CTES["g_labels"] = """
SELECT p.stop_id, r.root FROM g_parent AS p
JOIN (SELECT a, min(b) AS root FROM g_reach2 GROUP BY a) AS r ON r.a = p.label"""
CTES["g_members"] = """
SELECT 'group:' || min(coalesce(station, any_stop)) OVER (PARTITION BY root) AS group_id, stop_id
FROM (SELECT l.stop_id, l.root,
        min(CASE WHEN s.location_type = 1 THEN s.stop_id END) OVER (PARTITION BY root) AS station,
        min(s.stop_id) OVER (PARTITION BY root) AS any_stop
      FROM g_labels AS l JOIN v_stops AS s ON s.stop_id = l.stop_id) AS chosen"""
CTES["g_groups"] = """
SELECT m.group_id, any_value(named.name) AS name,
  round(coalesce(avg(CASE WHEN s.location_type = 1 THEN u.latitude END), avg(u.latitude)), 9)
    AS latitude,
  round(coalesce(avg(CASE WHEN s.location_type = 1 THEN u.longitude END), avg(u.longitude)), 9)
    AS longitude,
  round(min(u.latitude), 9) AS min_latitude, round(min(u.longitude), 9) AS min_longitude,
  round(max(u.latitude), 9) AS max_latitude, round(max(u.longitude), 9) AS max_longitude,
  count(*) AS member_count
FROM g_members AS m JOIN v_stops AS s ON s.stop_id = m.stop_id
LEFT JOIN g_usable AS u ON u.stop_id = m.stop_id
JOIN v_stops AS named ON 'group:' || named.stop_id = m.group_id
GROUP BY m.group_id"""
CTES["c_stop_route"] = """
SELECT DISTINCT st.stop_id, t.route_id
FROM t_stop_times AS st JOIN t_trips AS t ON t.trip_id = st.trip_id"""
CTES["g_member_routes"] = """
SELECT m.group_id, m.stop_id, r.route_id, r.agency_id
FROM g_members AS m JOIN c_stop_route AS sr ON sr.stop_id = m.stop_id
JOIN t_routes AS r ON r.route_id = sr.route_id"""
CTES["g_routes"] = f"""
SELECT DISTINCT m.group_id, {_columns(ROUTE_COLUMNS, "r")}
FROM g_member_routes AS m JOIN t_routes AS r ON r.route_id = m.route_id"""
CTES["g_agencies"] = """
SELECT DISTINCT g.group_id, a.agency_id, a.name, a.url, a.timezone
FROM g_routes AS g JOIN t_agencies AS a ON a.agency_id = g.agency_id"""

# Search: tokens with places, matching runs, BM25.
CTES["s_tokens"] = """
SELECT stop_id, field, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place
FROM (SELECT stop_id, field, list_filter(regexp_split_to_array(lower(strip_accents(text)),
        '[^a-z0-9]+'), lambda x: x <> '') AS tokens
      FROM (SELECT stop_id, 'name' AS field, name AS text FROM v_stops
            UNION ALL SELECT stop_id, 'code', coalesce(code, '') FROM v_stops) AS fields) AS split"""
CTES["s_terms"] = """
SELECT request_id, term, count(*) AS times,
  list_filter(regexp_split_to_array(term, '[^a-z0-9]+'), lambda x: x <> '') AS pieces
FROM (SELECT request_id, unnest(list_filter(regexp_split_to_array(lower(query), '\\s+'),
        lambda x: x <> '')) AS term FROM q_stop_search) AS t
GROUP BY request_id, term"""
CTES["s_pieces"] = """
SELECT term, length, piece, nth, nth = length AS is_last
FROM (SELECT term, len(pieces) AS length, unnest(pieces) AS piece,
        generate_subscripts(pieces, 1) AS nth
      FROM (SELECT DISTINCT term, pieces FROM s_terms) AS d) AS p"""
CTES["s_hits"] = """
SELECT term, stop_id, count(*) AS tf FROM (
  SELECT p.term, p.length, t.stop_id, t.field, t.place - p.nth AS start
  FROM s_pieces AS p JOIN s_tokens AS t
    ON t.token = p.piece OR (p.is_last AND starts_with(t.token, p.piece))
  GROUP BY ALL HAVING count(*) = p.length) AS runs
GROUP BY term, stop_id"""
CTES["s_scores"] = """
SELECT q.request_id, h.stop_id, round(sum(q.times
    * greatest(ln((c.n - d.df + 0.5e0) / (d.df + 0.5e0)), 1e-6) * h.tf * 2.2e0
    / (h.tf + 1.2e0 * (0.25e0 + 0.75e0 * l.length / (c.total / c.n)))), 9) AS score
FROM s_terms AS q JOIN s_hits AS h ON h.term = q.term
JOIN (SELECT term, count(*) AS df FROM s_hits GROUP BY term) AS d ON d.term = q.term
JOIN (SELECT stop_id, count(*) AS length FROM s_tokens GROUP BY stop_id) AS l
  ON l.stop_id = h.stop_id
CROSS JOIN (SELECT (SELECT count(*) FROM v_stops) AS n,
            (SELECT count(*) FROM s_tokens) AS total) AS c
GROUP BY q.request_id, h.stop_id
HAVING count(*) = (SELECT count(*) FROM s_terms AS w WHERE w.request_id = q.request_id)"""

CTES["c_points_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY sequence) AS rank,
  count(*) OVER (PARTITION BY shape_id) AS n FROM t_shape_points"""

CTES["c_found_routes"] = """
SELECT q.request_id, q."limit", lower(trim(q.query)) AS needle, r.*
FROM q_route_search AS q JOIN t_routes AS r ON trim(q.query) <> ''
  AND (contains(lower(r.route_id), lower(trim(q.query)))
    OR contains(lower(coalesce(r.short_name, '')), lower(trim(q.query)))
    OR contains(lower(coalesce(r.long_name, '')), lower(trim(q.query))))"""

CTES["c_calls"] = f"""
SELECT st.trip_id, {_columns(STOP_COLUMNS, "s")}, st.stop_sequence,
  {_text("st.arrival_seconds")} AS scheduled_arrival,
  st.arrival_seconds AS scheduled_arrival_seconds,
  {_text("st.departure_seconds")} AS scheduled_departure,
  st.departure_seconds AS scheduled_departure_seconds, st.stop_headsign AS headsign,
  st.pickup_type, st.drop_off_type, st.timepoint
FROM t_stop_times AS st JOIN v_stops AS s ON s.stop_id = st.stop_id"""

CTES["c_located_calls"] = """
SELECT st.trip_id, st.stop_sequence, st.stop_id, s.latitude, s.longitude
FROM t_stop_times AS st JOIN t_stops AS s ON s.stop_id = st.stop_id
WHERE s.latitude IS NOT NULL AND s.longitude IS NOT NULL"""

CTES["c_sizes"] = """
SELECT t.trip_id, t.route_id, t.shape_id, coalesce(c.n, 0) AS stop_calls,
  coalesce(p.n, 0) AS shape_points
FROM t_trips AS t
LEFT JOIN (SELECT trip_id, count(*) AS n FROM t_stop_times GROUP BY trip_id) AS c
  ON c.trip_id = t.trip_id
LEFT JOIN (SELECT shape_id, count(*) AS n FROM t_shape_points GROUP BY shape_id) AS p
  ON p.shape_id = t.shape_id"""

CTES["c_nearby"] = f"""
SELECT q.request_id, q."limit", s.*,
  {_haversine("q.lat", "q.lon", "s.latitude", "s.longitude")} AS distance
FROM a_nearby AS q JOIN v_stops AS s
  ON s.latitude BETWEEN q.lat - q.radius / 111320e0 AND q.lat + q.radius / 111320e0
  AND s.longitude
    BETWEEN q.lon - q.radius / (111320e0 * greatest(abs(cos(radians(q.lat))), 1e-2))
    AND q.lon + q.radius / (111320e0 * greatest(abs(cos(radians(q.lat))), 1e-2))"""

CTES["c_first_stops"] = """
SELECT stop_id, coalesce(location_type, 0) AS kind, parent_station AS parent
FROM x_stops QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY row_no) = 1"""

_PAGE_ROUTE = """q.query = '' OR contains(lower(r.route_id), lower(q.query))
  OR contains(lower(coalesce(r.short_name, '')), lower(q.query))
  OR contains(lower(coalesce(r.long_name, '')), lower(q.query))"""


def _page(inner: str, columns: str) -> str:
    return f"""SELECT request_id, nth AS position, total > {PAGE} AS has_more, {columns}
FROM ({inner}) AS page WHERE nth <= {PAGE}"""


def _agg(item: str, order: str) -> str:
    return f"coalesce(string_agg({item}, ' ' ORDER BY {order}), '')"


def _repeat(keys: str, table: str, columns: str) -> str:
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
  ORDER BY row_no) AS nth FROM {table}) AS numbered WHERE nth > 1"""


_TRANSFER_RECORD = """from_stop_id || ':' || to_stop_id || ':' || from_trip_id || ':' ||
  to_trip_id || ':' || from_route_id || ':' || to_route_id"""

CTES["c_ends"] = f"""
SELECT {_TRANSFER_RECORD} AS record, transfer_type, from_stop_id AS stop_id,
  from_trip_id AS trip_id, from_route_id AS route_id FROM x_transfers
UNION ALL SELECT {_TRANSFER_RECORD}, transfer_type, to_stop_id, to_trip_id, to_route_id
FROM x_transfers"""

VALIDATION_SQL = {
    "frequencies": """
SELECT 'unsupported_frequencies' AS code, 'frequencies.txt' AS record
FROM x_frequencies HAVING count(*) > 0""",
    "feed_info": """
SELECT 'incomplete_feed_info' AS code, 'feed_info.txt' AS record FROM x_feed_info
WHERE feed_publisher_name = '' OR feed_publisher_url = '' OR feed_lang = ''
UNION ALL SELECT 'invalid_feed_date_range', 'feed_info.txt' FROM x_feed_info
WHERE feed_start_date > feed_end_date
UNION ALL SELECT 'multiple_feed_info_records', 'feed_info.txt' FROM x_feed_info
HAVING count(*) > 1""",
    "agency": f"""
SELECT 'incomplete_agency' AS code, agency_id AS record FROM x_agency
WHERE agency_name = '' OR agency_url = '' OR agency_timezone = ''
UNION ALL {_repeat("agency_id", "x_agency", "'duplicate_agency', agency_id")}
UNION ALL SELECT 'missing_agency', 'agency.txt' FROM x_agency HAVING count(*) = 0
UNION ALL SELECT 'missing_agency_id', 'agency.txt' FROM x_agency
HAVING count(DISTINCT agency_id) > 1 AND bool_or(agency_id = '')""",
    "stops": f"""
SELECT 'missing_stop_id' AS code, 'stops.txt' AS record FROM x_stops WHERE stop_id = ''
UNION ALL {_repeat("stop_id", "x_stops", "'duplicate_stop', stop_id")}
UNION ALL SELECT 'invalid_coordinates', stop_id FROM x_stops
WHERE stop_lat IS NOT NULL AND stop_lon IS NOT NULL
  AND NOT (stop_lat BETWEEN -90 AND 90 AND stop_lon BETWEEN -180 AND 180)
UNION ALL SELECT 'incomplete_coordinates', stop_id FROM x_stops
WHERE (stop_lat IS NULL) <> (stop_lon IS NULL)""",
    "stop_hierarchy": """
SELECT CASE WHEN s.kind > 4 THEN 'invalid_location_type'
    WHEN s.kind = 1 THEN CASE WHEN s.parent <> '' THEN 'unexpected_parent_station' END
    WHEN s.parent = '' THEN CASE WHEN s.kind > 1 THEN 'missing_parent_station' END
    WHEN s.parent = s.stop_id THEN 'self_parent_station'
    WHEN p.stop_id IS NULL THEN 'unknown_parent_station'
    WHEN p.kind <> CASE WHEN s.kind = 4 THEN 0 ELSE 1 END THEN 'invalid_parent_location_type'
  END AS code, s.stop_id AS record
FROM c_first_stops AS s LEFT JOIN c_first_stops AS p ON p.stop_id = s.parent
WHERE code IS NOT NULL""",
    "routes": f"""
SELECT 'missing_route_id' AS code, 'routes.txt' AS record FROM x_routes WHERE route_id = ''
UNION ALL SELECT 'missing_route_name', route_id FROM x_routes
WHERE route_short_name = '' AND route_long_name = ''
UNION ALL {_repeat("route_id", "x_routes", "'duplicate_route', route_id")}
UNION ALL SELECT 'missing_route_agency', route_id FROM x_routes
WHERE agency_id = '' AND (SELECT count(DISTINCT agency_id) FROM x_agency) <> 1
UNION ALL SELECT 'unknown_agency', route_id FROM x_routes
WHERE agency_id <> '' AND agency_id NOT IN (SELECT agency_id FROM x_agency)""",
    "calendar": f"""
SELECT 'invalid_calendar_weekday' AS code, service_id AS record FROM x_calendar
WHERE greatest(monday, tuesday, wednesday, thursday, friday, saturday, sunday) > 1
UNION ALL SELECT 'invalid_calendar_range', service_id FROM x_calendar WHERE start_date > end_date
UNION ALL {_repeat("service_id", "x_calendar", "'duplicate_calendar', service_id")}""",
    "calendar_dates": f"""
SELECT 'invalid_exception_type' AS code,
  service_id || ':' || strftime(date, '%Y-%m-%d') AS record
FROM x_calendar_dates WHERE exception_type NOT IN (1, 2)
UNION ALL {_repeat("service_id, date", "x_calendar_dates",
                   "'duplicate_calendar_date', service_id || ':' || strftime(date, '%Y-%m-%d')")}""",
    "shapes": """
SELECT 'invalid_shape_coordinates' AS code, shape_id || ':' || shape_pt_sequence AS record
FROM x_shapes WHERE NOT (shape_pt_lat BETWEEN -90 AND 90 AND shape_pt_lon BETWEEN -180 AND 180)
UNION ALL SELECT 'invalid_shape_distance', shape_id || ':' || shape_pt_sequence FROM x_shapes
WHERE shape_dist_traveled < 0 OR isinf(shape_dist_traveled) OR isnan(shape_dist_traveled)
UNION ALL SELECT 'non_increasing_shape_sequence', shape_id || ':' || shape_pt_sequence
FROM (SELECT *, lag(shape_pt_sequence) OVER (PARTITION BY shape_id ORDER BY row_no) AS previous
      FROM x_shapes) AS s WHERE shape_pt_sequence <= previous""",
    "trips": f"""
SELECT 'incomplete_trip' AS code, trip_id AS record FROM x_trips
WHERE trip_id = '' OR route_id = '' OR service_id = ''
UNION ALL SELECT 'invalid_direction_id', trip_id FROM x_trips WHERE direction_id > 1
UNION ALL {_repeat("trip_id", "x_trips", "'duplicate_trip', trip_id")}
UNION ALL SELECT 'unknown_route', trip_id FROM x_trips
WHERE route_id NOT IN (SELECT route_id FROM x_routes)
UNION ALL SELECT 'unknown_service', trip_id FROM x_trips
WHERE service_id NOT IN (SELECT service_id FROM x_calendar
  UNION ALL SELECT service_id FROM x_calendar_dates)
UNION ALL SELECT 'unknown_shape', trip_id FROM x_trips
WHERE shape_id <> '' AND shape_id NOT IN (SELECT shape_id FROM x_shapes)""",
    "transfers": f"""
SELECT 'invalid_transfer_type' AS code, {_TRANSFER_RECORD} AS record FROM x_transfers
WHERE transfer_type > 5
UNION ALL SELECT 'missing_transfer_stop', {_TRANSFER_RECORD} FROM x_transfers
WHERE transfer_type <= 3 AND (from_stop_id = '' OR to_stop_id = '')
UNION ALL SELECT 'missing_linked_trip', {_TRANSFER_RECORD} FROM x_transfers
WHERE transfer_type IN (4, 5) AND (from_trip_id = '' OR to_trip_id = '')
UNION ALL SELECT 'missing_transfer_time', {_TRANSFER_RECORD} FROM x_transfers
WHERE transfer_type = 2 AND min_transfer_time IS NULL
UNION ALL {_repeat(
    "from_stop_id, to_stop_id, from_trip_id, to_trip_id, from_route_id, to_route_id",
    "x_transfers", f"'duplicate_transfer', {_TRANSFER_RECORD}")}
UNION ALL SELECT 'unknown_transfer_stop', record FROM c_ends
WHERE stop_id <> '' AND stop_id NOT IN (SELECT stop_id FROM x_stops)
UNION ALL SELECT 'invalid_transfer_stop_type', record FROM c_ends JOIN c_first_stops USING (stop_id)
WHERE stop_id <> '' AND NOT (kind = 0 OR (kind = 1 AND transfer_type NOT IN (4, 5)))
UNION ALL SELECT 'unknown_transfer_route', record FROM c_ends
WHERE route_id <> '' AND route_id NOT IN (SELECT route_id FROM x_routes)
UNION ALL SELECT 'unknown_transfer_trip', record FROM c_ends
WHERE trip_id <> '' AND trip_id NOT IN (SELECT trip_id FROM x_trips)
UNION ALL SELECT 'transfer_trip_route_mismatch', e.record FROM c_ends AS e
JOIN (SELECT trip_id, arg_min(route_id, row_no) AS actual FROM x_trips GROUP BY trip_id) AS t
  ON t.trip_id = e.trip_id
WHERE e.trip_id <> '' AND e.route_id <> '' AND e.route_id <> t.actual""",
    "stop_times": """
SELECT 'incomplete_stop_time' AS code, trip_id || ':' || stop_sequence AS record
FROM x_stop_times WHERE trip_id = '' OR stop_id = ''
UNION ALL SELECT 'invalid_stop_time_enum', trip_id || ':' || stop_sequence FROM x_stop_times
WHERE pickup_type > 3
UNION ALL SELECT 'invalid_stop_time_enum', trip_id || ':' || stop_sequence FROM x_stop_times
WHERE drop_off_type > 3
UNION ALL SELECT 'invalid_stop_time_enum', trip_id || ':' || stop_sequence FROM x_stop_times
WHERE timepoint > 1
UNION ALL SELECT 'unknown_trip', trip_id || ':' || stop_sequence FROM x_stop_times
WHERE trip_id NOT IN (SELECT trip_id FROM x_trips)
UNION ALL SELECT 'unknown_stop', trip_id || ':' || stop_sequence FROM x_stop_times
WHERE stop_id NOT IN (SELECT stop_id FROM x_stops)
UNION ALL SELECT 'non_increasing_stop_sequence', trip_id || ':' || stop_sequence
FROM (SELECT *, lag(stop_sequence) OVER (PARTITION BY trip_id ORDER BY row_no) AS previous
      FROM x_stop_times) AS s WHERE stop_sequence <= previous""",
}

for _family in RULE_FAMILIES:
    CTES[f"c_issues_{_family}"] = VALIDATION_SQL[_family]
CTES["c_issues"] = " UNION ALL ".join(
    f"SELECT code, record FROM c_issues_{family}" for family in RULE_FAMILIES
)

_STOP = _columns(STOP_COLUMNS, "s")
_ROUTE = _columns(ROUTE_COLUMNS, "r")
_TRIP = _columns(TRIP_COLUMNS, "t")
_SECONDS_PATTERN = r"^\+?[0-9]+:\+?[0-9]+:\+?[0-9]+$"


def _seconds(text: str) -> str:
    h, m, s = (f"try_cast(split_part({text}, ':', {n}) AS INTEGER)" for n in (1, 2, 3))
    return f"""CASE WHEN regexp_full_match({text}, '{_SECONDS_PATTERN}')
      AND {h} <= 99 AND {m} <= 59 AND {s} <= 59 THEN {h} * 3600 + {m} * 60 + {s} END"""


def _unreadable(column: str, condition: str) -> str:
    return f"""SELECT 'stop_times' AS file, row_no, '{column}' AS "column",
      {column} AS value FROM q_text_stop_times WHERE {condition}"""


def _number(text: str, maximum: int) -> str:
    return f"""coalesce(regexp_full_match({text}, '\\+?[0-9]+')
      AND try_cast({text} AS BIGINT) <= {maximum}, false)"""


def _problem(problem: str, condition: str, table: str) -> str:
    return f"""SELECT request_id, '{problem}' AS problem FROM {table}
      WHERE NOT coalesce({condition}, false)"""


_LIMIT = '("limit" IS NULL OR "limit" >= 1)'
_AT_MOST = 'nth <= coalesce("limit", 20)'
_DEGREES = "{0}lat BETWEEN -90 AND 90 AND {0}lon BETWEEN -180 AND 180"
_RADIUS = "radius BETWEEN 0 AND 20037509"
_ORDERED = "min_lat <= max_lat AND min_lon <= max_lon"
CTES["a_departures"] = f"SELECT * FROM q_departures WHERE {_LIMIT} AND after >= 0"
CTES["a_nearby"] = f"SELECT * FROM q_nearby WHERE {_LIMIT} AND {_DEGREES.format('')} AND {_RADIUS}"
CTES["a_rects"] = f"""SELECT * FROM q_rects WHERE {_LIMIT} AND {_ORDERED}
  AND {_DEGREES.format("min_")} AND {_DEGREES.format("max_")}"""

CTES["d_calls"] = f"""SELECT trip_id, part, {_agg(
    "stop_sequence || '/' || stop_id || '/' || coalesce(scheduled_departure, '-')", "stop_sequence")} AS calls
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence) - 1)
  // {DETAIL_PART} AS INTEGER) AS part FROM c_calls) AS ranked GROUP BY trip_id, part"""
CTES["d_shapes"] = f"""SELECT t.trip_id, p.part, {_agg("CAST(p.sequence AS VARCHAR)", "p.sequence")} AS shape
FROM t_trips AS t JOIN (SELECT *, CAST((rank - 1) // {DETAIL_PART} AS INTEGER) AS part
  FROM c_points_ranked) AS p ON p.shape_id = t.shape_id GROUP BY t.trip_id, p.part"""
CTES["d_parts"] = """SELECT trip_id, 0 AS part FROM t_trips UNION SELECT trip_id, part FROM d_calls
UNION SELECT trip_id, part FROM d_shapes"""

ORACLE_SQL: dict[str, str] = {
    "departures": f"""
SELECT request_id, stop_id, {_DEPARTURE} FROM (
  SELECT q.request_id, q.service_date, q."limit", b.*, row_number() OVER (
    PARTITION BY q.request_id ORDER BY departure_seconds, trip_id, stop_sequence) AS nth
  FROM a_departures AS q JOIN c_boardable AS b
    ON b.stop_id = q.stop_id AND b.departure_seconds >= q.after
  JOIN c_active AS a ON a.service_id = b.service_id AND a.service_date = q.service_date) AS d
WHERE {_AT_MOST} """,
    "departure_board": f"""
SELECT stop_id, CAST(nth AS INTEGER) AS rank, {_DEPARTURE} FROM (
  SELECT q.service_date, b.*, row_number() OVER (PARTITION BY b.stop_id, q.service_date
    ORDER BY departure_seconds, trip_id, stop_sequence) AS nth
  FROM q_dates AS q JOIN c_active AS a ON a.service_date = q.service_date
  JOIN c_boardable AS b ON b.service_id = a.service_id) AS d
WHERE nth <= {BOARD_SIZE}""",
    "service_active_on": """
SELECT service_id, strftime(service_date, '%Y-%m-%d') AS service_date FROM c_active
WHERE service_date IN (SELECT service_date FROM q_dates)""",
    "service_dates": """
SELECT service_id, strftime(service_date, '%Y-%m-%d') AS service_date FROM c_active""",
    "lookup_stops": f"""
SELECT q.request_id, {_STOP} FROM q_stops AS q JOIN v_stops AS s ON s.stop_id = q.stop_id""",
    "missing_stops": """
SELECT request_id, stop_id FROM q_stops WHERE stop_id NOT IN (SELECT stop_id FROM t_stops)""",
    "search_stops": f"""
SELECT request_id, CAST(nth AS INTEGER) AS rank, {", ".join(STOP_COLUMNS)}, round(score, 6) AS score
FROM (SELECT q.request_id, q."limit", {_STOP}, c.score, row_number() OVER (
    PARTITION BY q.request_id ORDER BY c.score DESC, s.name, s.stop_id) AS nth
  FROM q_stop_search AS q JOIN s_scores AS c ON c.request_id = q.request_id
  JOIN v_stops AS s ON s.stop_id = c.stop_id) AS found
WHERE {_AT_MOST} """,
    "nearby_stops": f"""
SELECT request_id, CAST(nth AS INTEGER) AS rank, {", ".join(STOP_COLUMNS)},
  round(distance, 3) AS distance_m
FROM (SELECT n.*, row_number() OVER (PARTITION BY n.request_id
    ORDER BY distance, stop_id) AS nth
  FROM c_nearby AS n JOIN a_nearby AS q ON q.request_id = n.request_id
  WHERE distance <= q.radius) AS found
WHERE {_AT_MOST} """,
    "stops_in_rect": f"""
SELECT request_id, {", ".join(STOP_COLUMNS)}
FROM (SELECT q.request_id, q."limit", {_STOP}, row_number() OVER (
    PARTITION BY q.request_id ORDER BY s.stop_id) AS nth
  FROM a_rects AS q JOIN v_stops AS s ON s.latitude BETWEEN q.min_lat AND q.max_lat
    AND s.longitude BETWEEN q.min_lon AND q.max_lon) AS found
WHERE nth <= coalesce("limit", 10000) """,
    "stop_routes": f"""
SELECT request_id, stop_id, {", ".join(ROUTE_COLUMNS)}
FROM (SELECT q.request_id, q."limit", q.stop_id, {_ROUTE}, row_number() OVER (
    PARTITION BY q.request_id ORDER BY r.route_id) AS nth
  FROM q_stop_routes AS q JOIN c_stop_route AS sr ON sr.stop_id = q.stop_id
  JOIN t_routes AS r ON r.route_id = sr.route_id) AS found
WHERE {_AT_MOST} """,
    "stop_trips": f"""
SELECT request_id, stop_id, strftime(service_date, '%Y-%m-%d') AS service_date,
  {", ".join(TRIP_COLUMNS)}
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY trip_id) AS nth
  FROM (SELECT DISTINCT q.request_id, q."limit", q.stop_id, q.service_date, {_TRIP}
    FROM q_stop_trips AS q JOIN t_stop_times AS st ON st.stop_id = q.stop_id
    JOIN t_trips AS t ON t.trip_id = st.trip_id
    JOIN c_active AS a ON a.service_id = t.service_id AND a.service_date = q.service_date) AS d
) AS found WHERE {_AT_MOST} """,
    "lookup_routes": f"""
SELECT q.request_id, {_ROUTE} FROM q_routes AS q JOIN t_routes AS r ON r.route_id = q.route_id""",
    "search_routes": f"""
SELECT request_id, CAST(nth AS INTEGER) AS rank, {", ".join(ROUTE_COLUMNS)}
FROM (SELECT *, row_number() OVER (PARTITION BY request_id
    ORDER BY CASE WHEN lower(short_name) = needle THEN 0 ELSE 1 END,
      short_name NULLS FIRST, long_name NULLS FIRST, route_id) AS nth
  FROM c_found_routes) AS found WHERE {_AT_MOST} """,
    "route_trips": f"""
SELECT request_id, strftime(service_date, '%Y-%m-%d') AS service_date, {", ".join(TRIP_COLUMNS)}
FROM (SELECT q.request_id, q."limit", q.service_date, {_TRIP}, row_number() OVER (
    PARTITION BY q.request_id ORDER BY t.trip_id) AS nth
  FROM q_route_trips AS q JOIN t_trips AS t ON t.route_id = q.route_id
  JOIN c_active AS a ON a.service_id = t.service_id AND a.service_date = q.service_date) AS found
WHERE {_AT_MOST} """,
    "route_shapes": """
SELECT request_id, route_id, CAST(nth AS INTEGER) AS rank, shape_id, trip_count
FROM (SELECT q.request_id, q.route_id, c.shape_id, c.trip_count, row_number() OVER (
    PARTITION BY q.request_id ORDER BY c.trip_count DESC, c.shape_id) AS nth
  FROM q_routes AS q JOIN (SELECT route_id, shape_id, count(*) AS trip_count FROM t_trips
    WHERE shape_id IS NOT NULL GROUP BY route_id, shape_id) AS c
    ON c.route_id = q.route_id) AS ranked""",
    "routes_page": _page(
        f"""SELECT q.request_id, {_ROUTE},
  CAST(row_number() OVER (PARTITION BY q.request_id ORDER BY r.route_id) AS INTEGER) AS nth,
  count(*) OVER (PARTITION BY q.request_id) AS total
FROM q_routes_page AS q JOIN t_routes AS r ON r.route_id > q.after_key AND ({_PAGE_ROUTE})""",
        ", ".join(ROUTE_COLUMNS),
    ),
    "trips_page": _page(
        f"""SELECT q.request_id, {_TRIP},
  CAST(row_number() OVER (PARTITION BY q.request_id ORDER BY t.trip_id) AS INTEGER) AS nth,
  count(*) OVER (PARTITION BY q.request_id) AS total
FROM q_trips_page AS q JOIN t_trips AS t
  ON t.route_id = q.route_id AND t.trip_id > q.after_key""",
        ", ".join(TRIP_COLUMNS),
    ),
    "lookup_trips": f"""
SELECT q.request_id, {_TRIP} FROM q_trips AS q JOIN t_trips AS t ON t.trip_id = q.trip_id""",
    "trip_calls": """
SELECT q.request_id, c.* FROM q_trips AS q JOIN c_calls AS c ON c.trip_id = q.trip_id""",
    "trip_shape": """
SELECT q.request_id, q.trip_id, p.sequence, p.latitude, p.longitude, p.distance_traveled
FROM q_trips AS q JOIN t_trips AS t ON t.trip_id = q.trip_id
JOIN t_shape_points AS p ON p.shape_id = t.shape_id""",
    "shape_points_of": """
SELECT q.request_id, q.shape_id, p.sequence, p.latitude, p.longitude, p.distance_traveled
FROM q_shapes AS q JOIN t_shape_points AS p ON p.shape_id = q.shape_id""",
    "trip_sizes": """
SELECT trip_id, stop_calls, shape_points, stop_calls > 8 AS too_many_calls,
  shape_points > 14 AS too_many_points FROM c_sizes""",
    "trip_detail": """
SELECT q.request_id, t.trip_id, t.route_id, d.part, coalesce(c.calls, '') AS calls,
  coalesce(s.shape, '') AS shape
FROM q_trips AS q JOIN t_trips AS t ON t.trip_id = q.trip_id JOIN d_parts AS d ON d.trip_id = t.trip_id
LEFT JOIN d_calls AS c ON c.trip_id = t.trip_id AND c.part = d.part
LEFT JOIN d_shapes AS s ON s.trip_id = t.trip_id AND s.part = d.part""",
    "shape_linestrings": f"""
SELECT shape_id, CAST((rank - 1) // 10 AS INTEGER) AS part, count(*) AS n_points,
  {_agg("sequence || '/' || printf('%.3f', longitude) || '/' || printf('%.3f', latitude)",
        "sequence")} AS line
FROM c_points_ranked GROUP BY shape_id, (rank - 1) // 10""",
    "trip_extent": """
SELECT trip_id, round(min(latitude), 9) AS min_lat, round(min(longitude), 9) AS min_lon,
  round(max(latitude), 9) AS max_lat, round(max(longitude), 9) AS max_lon,
  round((min(latitude) + max(latitude)) / 2, 9) AS center_lat,
  round((min(longitude) + max(longitude)) / 2, 9) AS center_lon
FROM (SELECT trip_id, latitude, longitude FROM c_located_calls
  UNION ALL SELECT t.trip_id, p.latitude, p.longitude
  FROM t_trips AS t JOIN t_shape_points AS p ON p.shape_id = t.shape_id) AS points
GROUP BY trip_id""",
    "colocated_calls": """
SELECT trip_id, stop_sequence, stop_id, latitude, longitude, calls_here
FROM (SELECT *, count(*) OVER (PARTITION BY trip_id, latitude, longitude) AS calls_here
  FROM c_located_calls) AS c WHERE calls_here > 1""",
    "thin_shapes": f"""
SELECT shape_id, sequence, latitude, longitude, distance_traveled FROM c_points_ranked
WHERE (rank - 1) % greatest(n // {THIN_TARGET}, 1) = 0 OR rank = n""",
    "stop_groups": "SELECT * FROM g_groups",
    "stop_group_members": "SELECT group_id, stop_id FROM g_members",
    "stop_groups_in_rect": f"""
SELECT * EXCLUDE (nth, "limit") FROM (SELECT q.request_id, q."limit", g.*, row_number() OVER (
    PARTITION BY q.request_id ORDER BY g.group_id) AS nth
  FROM a_rects AS q JOIN g_groups AS g ON g.latitude BETWEEN q.min_lat AND q.max_lat
    AND g.longitude BETWEEN q.min_lon AND q.max_lon) AS found
WHERE nth <= coalesce("limit", 10000) """,
    "group_member_routes": "SELECT * FROM g_member_routes",
    "group_routes": "SELECT * FROM g_routes",
    "group_agencies": "SELECT * FROM g_agencies",
    "stop_group_details": f"""
SELECT q.request_id, g.group_id, g.name, g.member_count, 0 AS part, m.members,
  coalesce(r.routes, '') AS routes, coalesce(a.agencies, '') AS agencies
FROM q_groups AS q JOIN g_groups AS g ON g.group_id = q.group_id
JOIN (SELECT group_id, {_agg("stop_id || '/' || route_ids || '/' || agency_ids", "stop_id")} AS members
  FROM (SELECT m.group_id, m.stop_id,
      coalesce(string_agg(DISTINCT x.route_id, '+' ORDER BY x.route_id), '') AS route_ids,
      coalesce(string_agg(DISTINCT x.agency_id, '+' ORDER BY x.agency_id), '') AS agency_ids
    FROM g_members AS m LEFT JOIN g_member_routes AS x
      ON x.group_id = m.group_id AND x.stop_id = m.stop_id
    GROUP BY m.group_id, m.stop_id) AS served GROUP BY group_id) AS m ON m.group_id = g.group_id
LEFT JOIN (SELECT group_id, {_agg("route_id", "route_id")} AS routes FROM g_routes
  GROUP BY group_id) AS r ON r.group_id = g.group_id
LEFT JOIN (SELECT group_id, {_agg("agency_id", "agency_id")} AS agencies FROM g_agencies
  GROUP BY group_id) AS a ON a.group_id = g.group_id""",
    "feed_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n FROM f_{name}"
        for name in FEED_SQL
        if name != "frequencies"
    ),
    "feed_file_issues": """
SELECT feed_id, 'invalid_path' AS problem, member FROM q_manifest
WHERE contains(member, '/') OR contains(member, '..')
UNION ALL SELECT feed_id, 'duplicate_file', member FROM q_manifest
GROUP BY feed_id, member HAVING count(*) > 1
UNION ALL SELECT feed_id, 'too_many_files', '' FROM q_manifest GROUP BY feed_id
HAVING count(*) > 64
UNION ALL SELECT feed_id, 'too_large', '' FROM q_manifest GROUP BY feed_id
HAVING sum(size) > 2147483648
UNION ALL SELECT f.feed_id, 'missing_file', n.member
FROM (SELECT DISTINCT feed_id FROM q_manifest) AS f
CROSS JOIN (VALUES ('agency.txt'), ('routes.txt'), ('stops.txt'), ('stop_times.txt'),
  ('trips.txt')) AS n(member)
WHERE NOT EXISTS (SELECT 1 FROM q_manifest AS m
  WHERE m.feed_id = f.feed_id AND m.member = n.member)
UNION ALL SELECT feed_id, 'missing_file', 'calendar.txt or calendar_dates.txt' FROM q_manifest
GROUP BY feed_id HAVING NOT bool_or(member IN ('calendar.txt', 'calendar_dates.txt'))""",
    "unreadable_records": " UNION ALL ".join(
        (
            _unreadable("arrival_time", f"arrival_time <> '' AND {_seconds('arrival_time')} IS NULL"),
            _unreadable(
                "departure_time", f"departure_time <> '' AND {_seconds('departure_time')} IS NULL"
            ),
            _unreadable("stop_sequence", f"NOT {_number('stop_sequence', 4294967295)}"),
            _unreadable("pickup_type", f"pickup_type <> '' AND NOT {_number('pickup_type', 255)}"),
        )
    ),
    "dangling_references": """
SELECT 'route' AS entity, route_id AS key, count(*) AS n FROM u_trips
WHERE route_id NOT IN (SELECT route_id FROM u_routes) GROUP BY route_id
UNION ALL SELECT 'trip', trip_id, count(*) FROM u_stop_times
WHERE trip_id NOT IN (SELECT trip_id FROM u_trips) GROUP BY trip_id
UNION ALL SELECT 'stop', stop_id, count(*) FROM u_stop_times
WHERE stop_id NOT IN (SELECT stop_id FROM u_stops) GROUP BY stop_id""",
    "parse_times": f"""
SELECT row_no, seconds, {_text("seconds")} AS text, seconds // 86400 AS day_offset,
  departure_seconds
FROM (SELECT row_no, {_seconds("arrival_time")} AS seconds,
  {_seconds("departure_time")} AS departure_seconds FROM q_text_stop_times) AS parsed""",
    "parse_dates": """
SELECT k, strftime(d, '%Y-%m-%d') AS iso,
  CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS compact,
  CAST(dayofweek(d) AS INTEGER) AS weekday
FROM (SELECT k, CASE WHEN regexp_full_match(text, '[1-9][0-9]{7}')
    THEN CAST(try_strptime(text, '%Y%m%d') AS DATE) END AS d FROM q_text_dates) AS parsed""",
    "schedule_metadata": """
SELECT (SELECT 'v' || count(*) FROM orders) AS schedule_version,
  (SELECT count(*) FROM lineitem) AS imported_at_unix,
  publisher_name, publisher_url, feed_lang, default_lang,
  strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date,
  source_version, contact_email, contact_url FROM t_feed_info""",
    "request_issues_departures": " UNION ALL ".join(
        (
            _problem("limit", _LIMIT, "q_text_departures"),
            _problem(
                "date",
                "regexp_full_match(date, '[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}')"
                " AND try_cast(date AS DATE) IS NOT NULL",
                "q_text_departures",
            ),
            _problem("after", f"({_seconds('after')}) IS NOT NULL", "q_text_departures"),
        )
    ),
    "request_issues_nearby": " UNION ALL ".join(
        (
            _problem("limit", _LIMIT, "q_odd_nearby"),
            _problem(
                "position", "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180", "q_odd_nearby"
            ),
            _problem("radius", _RADIUS, "q_odd_nearby"),
        )
    ),
    "request_issues_rect": " UNION ALL ".join(
        (
            _problem("limit", _LIMIT, "q_odd_rects"),
            _problem(
                "bounds",
                "min_lat BETWEEN -90 AND 90 AND max_lat BETWEEN -90 AND 90"
                " AND min_lon BETWEEN -180 AND 180 AND max_lon BETWEEN -180 AND 180",
                "q_odd_rects",
            ),
            _problem(
                "reversed_bounds", "min_lat <= max_lat AND min_lon <= max_lon", "q_odd_rects"
            ),
        )
    ),
    "request_issues_route_search": " UNION ALL ".join(
        (
            _problem("limit", _LIMIT, "q_route_search"),
            _problem("query", "trim(query) <> ''", "q_route_search"),
        )
    ),
    **{f"normalize_{table}": f"SELECT * FROM t_{table}" for table in Timetable.table_names()},
    "normalize_service_calendars": """
SELECT * REPLACE (strftime(start_date, '%Y-%m-%d') AS start_date,
  strftime(end_date, '%Y-%m-%d') AS end_date) FROM t_service_calendars""",
    "normalize_service_exceptions": """
SELECT * REPLACE (strftime(service_date, '%Y-%m-%d') AS service_date) FROM t_service_exceptions""",
    "normalize_feed_info": """
SELECT * REPLACE (strftime(start_date, '%Y-%m-%d') AS start_date,
  strftime(end_date, '%Y-%m-%d') AS end_date) FROM t_feed_info""",
    **{
        f"validate_{family}": f"SELECT code, record FROM c_issues_{family}"
        for family in RULE_FAMILIES
    },
    "validation_counts": "SELECT code, count(*) AS n FROM c_issues GROUP BY code",
    "validation_report": """
SELECT code, record, greatest((SELECT count(*) FROM c_issues) - 100, 0) AS omitted_issue_count
FROM c_issues ORDER BY code, record LIMIT 100""",
}


def with_ctes(body: str) -> str:
    """The query with the named subqueries it needs in front, each after those it uses."""
    names = re.compile(r"\b(" + "|".join(sorted(CTES, key=len, reverse=True)) + r")\b")
    ordered: list[str] = []

    def need(sql: str, inside: str | None = None) -> None:
        for name in names.findall(sql):
            if name != inside and name not in ordered:
                need(CTES[name], name)
                if name not in ordered:
                    ordered.append(name)

    need(body)
    if not ordered:
        return body.strip()
    return (
        "WITH RECURSIVE "
        + ", ".join(f"{name} AS ({CTES[name].strip()})" for name in ordered)
        + "\n"
        + body.strip()
    )


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(sql) for name, sql in ORACLE_SQL.items()}
