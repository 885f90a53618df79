"""Time buckets, aligned to the epoch in UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Candle lengths in minutes.
LENGTHS = (5, 15, 60, 240, 1440)


def bucket_start(time: Column, minutes: Column | int) -> Column:
    """Start of the half-open bucket that holds ``time``."""
    seconds = (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("long") * 60
    unix = F.unix_seconds(time)
    return F.timestamp_seconds(unix - F.pmod(unix, seconds))


def bucket_end(start: Column, minutes: Column | int) -> Column:
    seconds = (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("long") * 60
    return F.timestamp_seconds(F.unix_seconds(start) + seconds)


def at(as_of: datetime | str) -> Column:
    """The moment that a query takes as now; no query reads the clock."""
    return F.lit(str(as_of)).cast("timestamp")


def minutes_before(as_of: datetime | str, minutes: int) -> Column:
    return F.timestamp_seconds(F.unix_seconds(at(as_of)) - F.lit(60 * minutes))


def from_millis(millis: Column) -> Column:
    """Milliseconds to a time; none for values that aren't positive."""
    return F.when(millis > 0, F.timestamp_millis(millis))
