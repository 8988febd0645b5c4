"""Which service runs on which date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltline.functions import service_weekday
from haltline.schema import WEEKDAYS, Timetable

ADDED, REMOVED = 1, 2


def _flag_on(weekday: Column) -> Column:
    return F.element_at(F.array(*WEEKDAYS), weekday + 1)


def _runs_on(date: Column) -> Column:
    return _flag_on(service_weekday(date)) == 1


def _with_exceptions(weekly: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Removals only cancel weekly service; an addition always counts."""
    keys = ["service_id", "service_date"]
    removed = exceptions.filter(F.col("exception_type") == REMOVED).select(*keys)
    added = exceptions.filter(F.col("exception_type") == ADDED).select(*keys)
    return weekly.join(removed, keys, "left_anti").unionByName(added).distinct()


def service_dates(timetable: Timetable) -> DataFrame:
    """Every (service_id, service_date) the timetable runs."""
    weekly = (
        timetable.service_calendars.filter(F.col("start_date") <= F.col("end_date"))
        .withColumn(
            "service_date",
            F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))),
        )
        .filter(_runs_on(F.col("service_date")))
        .select("service_id", "service_date")
    )
    return _with_exceptions(weekly, timetable.service_exceptions)


def service_active_on(timetable: Timetable, dates: DataFrame) -> DataFrame:
    """(service_id, service_date) restricted to the `service_date` values asked for.

    Calendars meet dates on the calendar month, an equality join, instead of by date range.
    """
    wanted = dates.select("service_date").distinct()
    months = timetable.service_calendars.filter(
        F.col("start_date") <= F.col("end_date")
    ).withColumn(
        "month",
        F.explode(
            F.sequence(
                F.trunc("start_date", "MM"), F.trunc("end_date", "MM"), F.expr("interval 1 month")
            )
        ),
    )
    weekly = (
        months.join(wanted.withColumn("month", F.trunc("service_date", "MM")), "month")
        .filter(
            F.col("service_date").between(F.col("start_date"), F.col("end_date"))
            & _runs_on(F.col("service_date"))
        )
        .select("service_id", "service_date")
    )
    exceptions = timetable.service_exceptions.join(wanted, "service_date", "left_semi")
    return _with_exceptions(weekly, exceptions)
