"""Event time as epoch milliseconds, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000, 60_000, 3_600_000, 86_400_000


def millis(col: Column | str) -> Column:
    """Epoch milliseconds of a wall-clock timestamp column; what is below a millisecond is cut off, also before the epoch.

    Put together from the date and the time of day, so that no session time zone and no summer time has a part in it.
    """
    ts = F.col(col) if isinstance(col, str) else col
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    second = F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint")
    return days * DAY + F.hour(ts) * HOUR + F.minute(ts) * MINUTE + second


def floor_to(ts: Column, step: int) -> Column:
    """The multiple of step at or below ts, also for negative ts."""
    return ts - F.pmod(ts, F.lit(step))


def window_starts(ts: Column, size: int, slide: int) -> Column:
    """Starts of all windows [s, s + size) that hold ts; windows are aligned to the epoch."""
    last = floor_to(ts, slide)
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit((size - 1) // slide)), lambda k: last - k * slide), lambda s: s + size > ts)


def stamp(start: Column, size: int) -> Column:
    """The derived time of a window's results: its last millisecond."""
    return start + (size - 1)


def from_seconds(col: Column) -> Column:
    return col * SECOND


def from_hours(col: Column) -> Column:
    return col * HOUR
