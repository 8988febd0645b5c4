"""Request tables for the registered queries, as SQL over the given tables.

Every row of the table a request comes from asks; both engines read the same text.
"""

from __future__ import annotations

# Departures, routes and trips asked for by every platform, and one unknown stop per nation.
_ALL_STOPS = """
SELECT p_partkey AS k, 'P' || p_partkey AS stop_id FROM {part}
UNION ALL SELECT CAST(1000000000 + n_nationkey AS BIGINT) AS k, 'PX' || n_nationkey AS stop_id
FROM {nation}"""

REQUEST_SQL = {
    "stops": f"SELECT k AS request_id, stop_id FROM ({_ALL_STOPS}) AS s",
    # Four days and times of every stop; the last kind takes the default limit or is no request at all.
    "departures": " UNION ALL ".join(
        f"""
SELECT k * 4 + {n} AS request_id, stop_id,
  make_date(2024, 1, CAST(1 + (k + {5 * n}) % 28 AS INT)) AS service_date,
  CAST({"CASE WHEN k % 9 = 0 THEN -1 ELSE 50000 END" if n == 3 else f"28800 + ((k + {n}) * 613) % 50000"}
    AS INT) AS after,
  CAST({"CASE WHEN k % 9 > 4 THEN NULL ELSE k % 9 - 1 END" if n == 3 else f"1 + (k + {n}) % 6"} AS INT) AS "limit"
FROM ({_ALL_STOPS}) AS s"""
        for n in range(4)
    ),
    "stop_routes": f"""
SELECT k AS request_id, stop_id, CAST(1 + k % 30 AS INT) AS "limit" FROM ({_ALL_STOPS}) AS s""",
    "stop_trips": f"""
SELECT k AS request_id, stop_id, make_date(2024, 1, CAST(1 + k % 28 AS INT)) AS service_date,
  CAST(1 + k % 12 AS INT) AS "limit" FROM ({_ALL_STOPS}) AS s""",
    "dates": """
SELECT DISTINCT CAST(ts AS DATE) AS service_date FROM {events}""",
    "nearby": """
SELECT p_partkey AS request_id, 50.75e0 + ((p_partkey * 7919) % 275000) / 1e5 AS lat,
  3.4e0 + ((p_partkey * 104729) % 370000) / 1e5 AS lon,
  250e0 * (1 + p_partkey % 40) AS radius, CAST(1 + p_partkey % 30 AS INT) AS "limit"
FROM {part}
UNION ALL
SELECT CAST(1000000000 + r_regionkey AS BIGINT) AS request_id,
  CASE WHEN r_regionkey = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 51e0 END AS lat, 4e0 AS lon,
  CASE r_regionkey WHEN 1 THEN 1e11 WHEN 2 THEN -1e0 WHEN 3 THEN CAST('NaN' AS DOUBLE) ELSE 2e4 END AS radius,
  CAST(NULL AS INT) AS "limit"
FROM {region}""",
    "rects": """
SELECT s_suppkey AS request_id, 50.75e0 + (s_suppkey % 20) * 1e-1 AS min_lat,
  3.4e0 + (s_suppkey % 30) * 1e-1 AS min_lon,
  50.75e0 + (s_suppkey % 20) * 1e-1 + (1 + s_suppkey % 7) * 5e-2 AS max_lat,
  3.4e0 + (s_suppkey % 30) * 1e-1 + (1 + s_suppkey % 9) * 7e-2 AS max_lon,
  CAST(1 + s_suppkey % 50 AS INT) AS "limit"
FROM {supplier}
UNION ALL
SELECT CAST(1000000000 + r_regionkey AS BIGINT) AS request_id, 50.75e0 + r_regionkey * 5e-1 AS min_lat,
  3.4e0 AS min_lon, 51.25e0 + r_regionkey * 5e-1 AS max_lat, 7.1e0 AS max_lon,
  CAST(CASE WHEN r_regionkey < 4 THEN 10000 END AS INT) AS "limit"
FROM {region}
UNION ALL
SELECT CAST(2000000000 + r_regionkey AS BIGINT) AS request_id, -9e1 AS min_lat,
  CASE WHEN r_regionkey = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE -18e1 END AS min_lon, 9e1 AS max_lat,
  CASE WHEN r_regionkey = 1 THEN -181e0 ELSE 18e1 END AS max_lon,
  CAST(r_regionkey * 50 - 100 AS INT) AS "limit"
FROM {region}""",
    "stop_search": """
SELECT s_suppkey AS request_id,
  CASE s_suppkey % 5 WHEN 0 THEN 'halt ' || s_suppkey WHEN 1 THEN ' STATION  ' || (s_suppkey % 10)
    WHEN 2 THEN 'sc' || s_suppkey WHEN 3 THEN 'Halt ' || s_suppkey || '-1'
    ELSE 'ha ' || (s_suppkey % 100) || ' 2' END AS query,
  CAST(1 + s_suppkey % 40 AS INT) AS "limit"
FROM {supplier}
UNION ALL SELECT CAST(1000000000 + r_regionkey AS BIGINT) AS request_id,
  CASE r_regionkey WHEN 0 THEN '' WHEN 1 THEN 'halt' WHEN 2 THEN 'halt halt 3'
    WHEN 3 THEN '- halt' ELSE 'nowhere' END AS query, 100 AS "limit"
FROM {region}""",
    "route_search": """
SELECT n_nationkey AS request_id, CAST(n_nationkey AS STRING) AS query,
  1 + n_nationkey % 10 AS "limit" FROM {nation}
UNION ALL SELECT 100 + n_nationkey AS request_id, ' ' || n_name AS query, 5 AS "limit" FROM {nation}
UNION ALL SELECT 200 + r_regionkey AS request_id,
  CASE r_regionkey WHEN 0 THEN '   ' WHEN 1 THEN 'line nation_1' WHEN 2 THEN 'r1' WHEN 3 THEN 'LINE'
    ELSE 'none' END AS query, 100 AS "limit" FROM {region}""",
    "routes": """
SELECT n_nationkey AS request_id, 'R' || n_nationkey AS route_id FROM {nation}
UNION ALL SELECT 100 + r_regionkey AS request_id, 'RX' || r_regionkey AS route_id FROM {region}""",
    "route_trips": """
SELECT n_nationkey * 1000 + day AS request_id, 'R' || n_nationkey AS route_id,
  make_date(2024, 1, day) AS service_date, 1 + (n_nationkey + day) % 25 AS "limit"
FROM {nation} JOIN (SELECT DISTINCT CAST(day(ts) AS INT) AS day FROM {events}) AS days
  ON day % 3 = n_nationkey % 3""",
    "routes_page": """
SELECT n_nationkey AS request_id, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'Nation_1' END AS query,
  CASE WHEN n_nationkey < 3 THEN '' ELSE 'R' || n_nationkey END AS after_key
FROM {nation}""",
    "trips_page": """
SELECT c_custkey AS request_id, 'R' || c_nationkey AS route_id,
  CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'T' || c_custkey END AS after_key
FROM {customer}""",
    "trips": """
SELECT o_orderkey AS request_id, 'T' || o_orderkey AS trip_id FROM {orders}
UNION ALL SELECT CAST(-1 - r_regionkey AS BIGINT) AS request_id, 'TX' || r_regionkey AS trip_id
FROM {region}""",
    "shapes": """
SELECT c_custkey AS request_id, 'H' || (c_custkey % 120) AS shape_id FROM {customer}""",
    "groups": """
SELECT s_suppkey AS request_id, 'group:S' || s_suppkey AS group_id FROM {supplier}
UNION ALL SELECT CAST(1000000000 + p_partkey AS BIGINT) AS request_id,
  'group:P' || p_partkey AS group_id FROM {part}""",
    "text_departures": """
SELECT p_partkey AS request_id, 'P' || p_partkey AS stop_id,
  CASE p_partkey % 7 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '20240101' ELSE '2024-01-15' END AS date,
  CASE p_partkey % 6 WHEN 0 THEN '24:61:00' WHEN 1 THEN '8:00' WHEN 2 THEN '+8:5:09'
    WHEN 3 THEN ' 8:00:00' ELSE '25:10:00' END AS after,
  CAST(p_partkey % 130 - 5 AS INT) AS "limit" FROM {part}""",
    "odd_nearby": """
SELECT p_partkey AS request_id, (p_partkey % 200 - 95) * 1e0 AS lat,
  (p_partkey % 390 - 190) * 1e0 AS lon, (p_partkey % 1200) * 1e2 - 500e0 AS radius,
  CAST(p_partkey % 130 - 5 AS INT) AS "limit" FROM {part}""",
    "odd_rects": """
SELECT p_partkey AS request_id, (p_partkey % 200 - 95) * 1e0 AS min_lat,
  (p_partkey % 390 - 190) * 1e0 AS min_lon, (p_partkey % 180 - 85) * 1e0 AS max_lat,
  (p_partkey % 370 - 180) * 1e0 AS max_lon, CAST(p_partkey % 26000 - 5 AS INT) AS "limit"
FROM {part}""",
    # One archive per block of twenty parts, its members chosen by part number.
    "manifest": """
SELECT 'feed-' || b AS feed_id,
  CASE (k + b) % 20 WHEN 0 THEN 'agency.txt' WHEN 1 THEN 'stops.txt' WHEN 2 THEN 'routes.txt'
    WHEN 3 THEN 'trips.txt' WHEN 4 THEN 'stop_times.txt'
    WHEN 5 THEN CASE WHEN b % 3 = 0 THEN 'notes.txt' ELSE 'calendar.txt' END
    WHEN 6 THEN CASE WHEN b % 4 = 0 THEN 'extra.txt' ELSE 'calendar_dates.txt' END
    WHEN 7 THEN CASE WHEN b % 11 = 1 THEN 'folder/shapes.txt' ELSE 'shapes.txt' END
    WHEN 8 THEN CASE WHEN b % 13 = 2 THEN '../transfers.txt' ELSE 'transfers.txt' END
    WHEN 9 THEN CASE WHEN b % 7 = 3 THEN 'stops.txt' ELSE 'feed_info.txt' END
    ELSE 'file' || (k % 20) || '.txt' END AS member,
  CAST(p_size * CAST(6000000 AS BIGINT) AS BIGINT) AS size
FROM (SELECT p_partkey AS k, CAST(floor(p_partkey / 20) AS BIGINT) AS b, p_size FROM {part}) AS p
WHERE NOT (b % 17 = 5 AND (k + b) % 20 < 2)""",
    # Raw text of stop times with unreadable values in it.
    "text_stop_times": """
SELECT 'T' || l_orderkey AS trip_id,
  CASE WHEN l_partkey % 211 = 1 THEN '12:60:00' WHEN l_partkey % 211 = 2 THEN ''
    ELSE CAST(CAST(floor(l_orderkey / 7) AS BIGINT) % 30 AS STRING) || ':' || (l_partkey % 60) || ':0' || (l_suppkey % 10)
  END AS arrival_time,
  CASE WHEN l_partkey % 223 = 3 THEN '100:00:00' WHEN l_partkey % 223 = 4 THEN 'noon'
    WHEN l_partkey % 223 = 5 THEN '1:2:3:4' ELSE '25:10:30' END AS departure_time,
  'P' || l_partkey AS stop_id,
  CASE WHEN l_partkey % 227 = 6 THEN '' WHEN l_partkey % 227 = 7 THEN '-1'
    WHEN l_partkey % 227 = 8 THEN ' 5' WHEN l_partkey % 227 = 9 THEN '+5'
    ELSE CAST(l_linenumber AS STRING) END AS stop_sequence,
  CASE WHEN l_partkey % 229 = 8 THEN '256' WHEN l_partkey % 229 = 9 THEN '255' ELSE '' END
    AS pickup_type,
  l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS row_no
FROM {lineitem}""",
    "text_dates": """
SELECT p_partkey AS k,
  CAST(1990 + p_partkey % 40 AS STRING)
    || CASE WHEN p_partkey % 14 < 10 THEN '0' ELSE '' END || (p_partkey % 14)
    || CASE WHEN p_partkey % 33 < 10 THEN '0' ELSE '' END || (p_partkey % 33) AS text
FROM {part}
UNION ALL SELECT -1 - s_suppkey AS k,
  CASE s_suppkey % 4 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '0999' || '0101' WHEN 2 THEN ''
    ELSE '2024021' END AS text FROM {supplier}""",
}

SPARK_REQUEST_SQL = {name: sql.replace('"limit"', "limit") for name, sql in REQUEST_SQL.items()}
