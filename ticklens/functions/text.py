"""Parsing of the text formats the feeds use. Every function returns a Column."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of the feeds.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
UNKNOWN_MONTH = "NA"
THOUSANDS = "K"
HEADER_TIME = "Time"
GAP_LINE = r"Gap of ([0-9]+)s found between ([0-9]+) and ([0-9]+)."
WHOLE_GAP_LINE = f"^{GAP_LINE}$"
TICK_TIME = r"^[0-9]{8} [0-9]{9}$"


def int_part(text: Column, start: int, length: int) -> Column:
    """The integer at a position of a text; NULL where there is none."""
    return F.substring(text, start, length).try_cast("int")


def tick_parts(trade_dt: Column) -> dict[str, Column]:
    """Day and clock fields of a `YYYYMMDD HHMMSSmmm` text."""
    return {
        "day": F.substring(trade_dt, 1, 8),
        "hour": int_part(trade_dt, 10, 2),
        "min": int_part(trade_dt, 12, 2),
        "sec": int_part(trade_dt, 14, 2),
        "milli": int_part(trade_dt, 16, 3),
    }


def figure(text: Column) -> Column:
    """A release figure such as `-17K` as an integer, fractions cut off; NULL if empty or no number."""
    return F.replace(text, F.lit(THOUSANDS), F.lit("")).try_cast("decimal(38,6)").try_cast("int")


def month_number(release_date: Column) -> Column:
    """`01` to `12` for a `Mon DD, YYYY` date, or the unknown mark."""
    position = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(release_date, 1, 3))
    return F.when(position > 0, F.lpad(position.cast("string"), 2, "0")).otherwise(UNKNOWN_MONTH)


def release_day(release_date: Column) -> Column:
    """`YYYYMMDD` of a `Mon DD, YYYY` date. An unknown month stays visible in the key."""
    return F.concat(
        F.substring(release_date, 9, 4),
        month_number(release_date),
        F.substring(release_date, 5, 2),
    )


def day_clock_timestamp(
    day: Column,
    hour: Column,
    minute: Column,
    second: Column | None = None,
    milli: Column | None = None,
) -> Column:
    """Wall-clock time of a `YYYYMMDD` text and clock fields; NULL if they name no time.

    No time zone takes part, so results do not move with daylight saving.
    """
    seconds = F.lit(0) if second is None else second
    millis = F.lit(0) if milli is None else milli
    return F.try_make_timestamp_ntz(
        int_part(day, 1, 4),
        int_part(day, 5, 2),
        int_part(day, 7, 2),
        hour,
        minute,
        (seconds + millis * F.lit(0.001).cast("decimal(4,3)")).cast("decimal(16,6)"),
    )


def tick_timestamp(trade_dt: Column) -> Column:
    """Wall-clock time of a `YYYYMMDD HHMMSSmmm` text."""
    part = tick_parts(trade_dt)
    return day_clock_timestamp(part["day"], part["hour"], part["min"], part["sec"], part["milli"])


def plus_minutes(ts: Column, minutes: int) -> Column:
    return ts + F.lit(timedelta(minutes=minutes))


def time_label(hour: Column, minute: Column) -> Column:
    """`8:30`; not zero-padded."""
    return F.concat(hour.cast("string"), F.lit(":"), minute.cast("string"))


def compact_time_label(hour: Column, minute: Column) -> Column:
    """`830`; not zero-padded, hence ambiguous: for output only, never a key."""
    return F.concat(hour.cast("string"), minute.cast("string"))
