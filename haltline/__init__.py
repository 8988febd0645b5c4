"""Timetable analytics on Spark: GTFS feeds in, DataFrames out."""
