from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from haltline.functions import (
    day_offset,
    fold_text,
    gtfs_date,
    gtfs_seconds,
    gtfs_time_text,
    haversine_m,
    iso_to_date,
    normalize_name,
    search_terms,
    service_weekday,
    strict_double,
    strict_long,
    usable_position,
    valid_coordinates,
)


def column_of(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row.r for row in df.select("i", expression.alias("r")).orderBy("i").collect()]


def test_times_go_past_midnight_without_wrapping(spark):
    v = F.col("v")
    assert column_of(spark, ["25:10:30", "+1:2:3", "99:59:59"], gtfs_seconds(v)) == [
        90_630,
        3_723,
        359_999,
    ]
    assert column_of(spark, [90_630, 0, 360_000, None], gtfs_time_text(v), "int") == [
        "25:10:30",
        "00:00:00",
        "100:00:00",
        None,
    ]
    assert column_of(spark, [90_630, 5], day_offset(v), "int") == [1, 0]


@pytest.mark.parametrize(
    "text", ["12:60:00", "12:00:60", "100:00:00", "12:00", "", " 1:00:00", "1:2:3:4", "-1:00:00", None]
)
def test_unreadable_times(spark, text):
    assert column_of(spark, [text], gtfs_seconds(F.col("v"))) == [None]


def test_dates(spark):
    texts = ["20240229", "20230229", "09990101", "2024-01-01", "2024011", "20241301", ""]
    got = column_of(spark, texts, gtfs_date(F.col("v")))
    assert got == [datetime.date(2024, 2, 29)] + [None] * 6
    iso = column_of(spark, ["2026-09-28", "2026-é-28", "2026-9-28"], iso_to_date(F.col("v")))
    assert iso == [datetime.date(2026, 9, 28), None, None]


def test_weekdays_count_from_sunday(spark):
    weekday = service_weekday(F.col("v").cast("date"))
    assert column_of(spark, ["2026-09-28", "1970-01-01", "2026-09-27"], weekday) == [1, 4, 0]


def test_strict_numbers(spark):
    texts = ["5", "+5", " 5", "5 ", "-1", "", "256", "5.0"]
    got = column_of(spark, texts, strict_long(F.col("v"), 255))
    assert got == [5, 5, None, None, None, None, None, None]
    doubles = ["1.5", ".5", "5.", "1e3", "inf", " 1", "1d", "0x1", ""]
    got = column_of(spark, doubles, strict_double(F.col("v")))
    assert got == [1.5, 0.5, 5.0, 1000.0, float("inf"), None, None, None, None]


def test_positions(spark):
    df = spark.createDataFrame(
        [
            (52.0, 5.0),
            (0.0, 0.0),
            (None, None),
            (52.0, None),
            (91.0, 5.0),
            (float("nan"), 5.0),
        ],
        "lat double, lon double",
    )
    lat, lon = F.col("lat"), F.col("lon")
    rows = df.select(
        valid_coordinates(lat, lon).alias("valid"), usable_position(lat, lon).alias("usable")
    ).collect()
    assert [row.valid for row in rows] == [True, True, True, False, False, False]
    assert [row.usable for row in rows][:4] == [True, False, False, False]


def test_haversine_of_one_degree(spark):
    value = haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    assert column_of(spark, ["x"], value)[0] == pytest.approx(111_194.93, abs=0.01)


def test_text(spark):
    assert column_of(spark, ["  Den \t Haag "], normalize_name(F.col("v"))) == ["den haag"]
    assert column_of(spark, ["Čáfé ÉÉN é"], fold_text(F.col("v"))) == ["cafe een e"]
    assert column_of(spark, ["  a  b ", ""], search_terms(F.col("v"))) == [["a", "b"], []]
