"""Read times as minutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratewell.functions.text import token


def whole_minutes(seconds: Column) -> Column:
    """Seconds to whole minutes, halves to the even minute."""
    return F.bround(seconds / F.lit(60.0), 0)


def clock_seconds(date_time: Column | str) -> Column:
    """Seconds of the h:m:s part of a ``date h:m:s`` text."""
    clock = token(date_time, " ", 2)
    hours, minutes, seconds = (token(clock, ":", k).try_cast("double") for k in (1, 2, 3))
    return hours * 3600 + minutes * 60 + seconds


def clock_minutes(date_time: Column | str) -> Column:
    """Whole minutes of the time of day; reads past midnight start again at 0."""
    return whole_minutes(clock_seconds(date_time))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end`` with microseconds kept; wall-clock times have no time zone."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)
