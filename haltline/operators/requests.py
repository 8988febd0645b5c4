"""Checks on request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltline.functions import gtfs_seconds, iso_to_date, within_degrees

#: Half of the way around the earth: no two places are farther apart.
MAX_RADIUS_M = 20_037_509.0


def _false_if_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def limit_ok(maximum: int | None = None) -> Column:
    """At least 1; a missing limit takes the default. An upper end only where the caller sets one."""
    within = F.col("limit") >= 1
    if maximum is not None:
        within &= F.col("limit") <= maximum
    return F.col("limit").isNull() | within


def date_ok() -> Column:
    return iso_to_date(F.col("date")).isNotNull()


def after_ok() -> Column:
    return gtfs_seconds(F.col("after")).isNotNull()


def service_date_ok() -> Column:
    return F.col("service_date").isNotNull()


def after_seconds_ok() -> Column:
    return F.col("after") >= 0


def position_ok() -> Column:
    return within_degrees(F.col("lat"), F.col("lon"))


def radius_ok(maximum: float = MAX_RADIUS_M) -> Column:
    return F.col("radius").between(0.0, maximum)


def bounds_ok() -> Column:
    return within_degrees(F.col("min_lat"), F.col("min_lon")) & within_degrees(
        F.col("max_lat"), F.col("max_lon")
    )


def bounds_ordered() -> Column:
    return (F.col("min_lat") <= F.col("max_lat")) & (F.col("min_lon") <= F.col("max_lon"))


def query_ok() -> Column:
    return F.trim(F.col("query")) != ""


def request_rules(
    requests: DataFrame,
    kind: str,
    max_limit: int | None = None,
    max_radius: float = MAX_RADIUS_M,
) -> dict[str, Column]:
    """Problem name to the condition a request of this kind must meet.

    Dates and times are checked as text (`date`, `after`) or, where the table has a `service_date`,
    as typed values.
    """
    typed = "service_date" in requests.columns
    limit = {"limit": limit_ok(max_limit)}
    date = {"date": service_date_ok() if typed else date_ok()}
    rect = {**limit, "bounds": bounds_ok(), "reversed_bounds": bounds_ordered()}
    rules = {
        "departures": {**limit, **date, "after": after_seconds_ok() if typed else after_ok()},
        "stop_trips": {**limit, **date},
        "route_trips": {**limit, **date},
        "stop_routes": limit,
        "search_stops": limit,
        "search_routes": {**limit, "query": query_ok()},
        "nearby_stops": {**limit, "position": position_ok(), "radius": radius_ok(max_radius)},
        "stops_in_rect": rect,
        "stop_groups_in_rect": rect,
    }
    return rules[kind]


def request_issues(requests: DataFrame, kind: str, **bounds: float) -> DataFrame:
    """(request_id, problem), one row per rule a request breaks. No shuffle."""
    rules = request_rules(requests, kind, **bounds)
    problems = F.array_compact(
        F.array(
            *(
                F.when(~_false_if_null(condition), F.lit(problem))
                for problem, condition in rules.items()
            )
        )
    )
    return requests.select("request_id", F.explode(problems).alias("problem"))


def valid_requests(requests: DataFrame, kind: str, **bounds: float) -> DataFrame:
    """Requests that break no rule; every operator starts from these."""
    condition = F.lit(True)
    for rule in request_rules(requests, kind, **bounds).values():
        condition &= _false_if_null(rule)
    return requests.filter(condition)


def missing_keys(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Requests whose key the table does not have."""
    return requests.join(table.select(key), key, "left_anti")
