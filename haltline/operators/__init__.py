"""Batched timetable operators: a DataFrame of requests in, all answers out."""
