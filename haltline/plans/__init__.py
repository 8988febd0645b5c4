"""The given tables seen as a GTFS feed, and the queries registered over it."""
