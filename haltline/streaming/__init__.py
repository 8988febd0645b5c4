"""Feeds that keep arriving."""
