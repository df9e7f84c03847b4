"""Operators: DataFrame in, DataFrame out, lazy, keyed by station.

Windows are always partitioned by station and run on at most one row per station and day (or
month), so a window partition is bounded by the calendar, however many raw readings a station
has. Whatever sees raw readings is an aggregation with a partial phase.
"""
