"""Service-day times: seconds since the start of the service day, never wrapped at 24 h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_PATTERN = r"^\+?[0-9]+:\+?[0-9]+:\+?[0-9]+$"
USUAL_TIME_PATTERN = r"^[0-9]{2}:[0-5][0-9]:[0-5][0-9]$"
MAX_HOUR = 99


def gtfs_seconds(text: Column) -> Column:
    """`H:M:S` to seconds; NULL when the text is not a service-day time.

    Nearly all times are written `HH:MM:SS`, which needs no splitting.
    """
    usual = (
        F.substring(text, 1, 2).cast("int") * 3600
        + F.substring(text, 4, 2).cast("int") * 60
        + F.substring(text, 7, 2).cast("int")
    )
    hour, minute, second = (
        F.split_part(text, F.lit(":"), F.lit(n)).try_cast("int") for n in (1, 2, 3)
    )
    readable = (
        text.rlike(TIME_PATTERN) & (hour <= MAX_HOUR) & (minute <= 59) & (second <= 59)
    )
    return F.when(text.rlike(USUAL_TIME_PATTERN), usual).when(
        readable, hour * 3600 + minute * 60 + second
    )


def gtfs_time_text(seconds: Column) -> Column:
    """Seconds to `HH:MM:SS` with an hour that may exceed 23."""
    seconds = seconds.cast("long")
    return F.when(
        seconds.isNotNull(),
        F.format_string(
            "%02d:%02d:%02d",
            F.floor(seconds / 3600),
            F.floor(F.pmod(seconds, F.lit(3600)) / 60),
            F.pmod(seconds, F.lit(60)),
        ),
    )


def day_offset(seconds: Column) -> Column:
    """How many calendar days after the service date the time falls."""
    return F.floor(seconds / 86400).cast("int")
