"""Service dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPACT_PATTERN = r"^[1-9][0-9]{7}$"
ISO_PATTERN = r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}$"


def gtfs_date(text: Column) -> Column:
    """`yyyymmdd` to DATE; NULL unless it is a real calendar day from year 1000 on."""
    return F.when(
        text.rlike(COMPACT_PATTERN),
        F.concat_ws(
            "-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)
        ).try_cast("date"),
    )


def iso_to_date(text: Column) -> Column:
    """`yyyy-mm-dd` to DATE with the same checks as `gtfs_date`."""
    return F.when(text.rlike(ISO_PATTERN), text.try_cast("date"))


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def compact_date(date: Column) -> Column:
    """DATE as the integer yyyymmdd."""
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


def service_weekday(date: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(date) - 1
