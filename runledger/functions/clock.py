"""Time arithmetic in whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def seconds_between(start: Column, end: Column) -> Column:
    """end - start in seconds, as a double."""
    return (micros(end) - micros(start)) / F.lit(float(SECOND))


def time_slice(ts: Column | str, width_us: int) -> Column:
    """Number of the ``width_us`` wide slice that holds ``ts``."""
    us = micros(ts)
    return F.call_function("div", us - F.pmod(us, F.lit(width_us)), F.lit(width_us))


def tick_up(ts: Column | str, step_us: int) -> Column:
    """First multiple of ``step_us`` at or after ``ts``, in microseconds."""
    us = micros(ts)
    return us + F.pmod(-us, F.lit(step_us))
