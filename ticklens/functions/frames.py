"""Time frames: the minutes that follow a release.

A frame of n minutes starts at the release time and always excludes that
instant. Its end is excluded too (`open`) or included (`half_open`).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.functions.text import day_clock_timestamp, plus_minutes

BOUNDS = ("open", "half_open")


def checked_frames(frames: Iterable[int]) -> list[int]:
    """The frames in ascending order, each once."""
    minutes = sorted({int(n) for n in frames})
    if not minutes or minutes[0] < 1:
        raise ValueError("frames must be one or more positive minute counts")
    return minutes


def with_frame_ends(releases: DataFrame, frames: Iterable[int]) -> DataFrame:
    """Add `release_ts` and one `frame_end_<n>` per frame.

    Done on the small side of the join, so that a quote is only compared.
    """
    release_ts = day_clock_timestamp(
        F.col("trading_day"), F.col("trading_hour"), F.col("trading_min")
    )
    ends = {f"frame_end_{n}": plus_minutes(F.col("release_ts"), n) for n in checked_frames(frames)}
    return releases.withColumn("release_ts", release_ts).withColumns(ends)


def minute_number(ts: Column) -> Column:
    """The number of the minute a time lies in, counted without a break over days."""
    return F.unix_date(ts.cast("date")).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def minute_band(minute: Column, width: int) -> Column:
    """The number of the stretch of `width` minutes that a minute lies in."""
    return F.floor(minute / width)


def on_the_minute(ts: str = "ts") -> Column:
    """Whether a time is the first instant of its minute, where frames start and end."""
    return F.expr(f"extract(SECOND FROM {ts}) = 0")


def frame_of_minute(frames: Iterable[int], bounds: str = "open") -> Column:
    """The shortest frame that holds the quotes of a `minute`, or NULL outside all of them.

    Quotes on the minute (`edge`) come apart from the later ones of the minute, since a frame excludes the instant
    it starts at, and as bounds say the one it ends at.
    """
    offset = "(minute - release_minute)"
    last = "0" if _before(bounds) == "<=" else "1"
    reach = f"{offset} + CASE WHEN edge THEN {last} ELSE 1 END"
    cases = " ".join(f"WHEN {reach} <= {n} THEN {n}" for n in checked_frames(frames))
    return F.expr(f"CASE WHEN {offset} < 0 OR (edge AND {offset} = 0) THEN NULL {cases} END")


def _before(bounds: str) -> str:
    if bounds not in BOUNDS:
        raise ValueError(f"bounds must be one of {BOUNDS}")
    return "<" if bounds == "open" else "<="


def in_frame(minutes: int, bounds: str = "open", ts: str = "ts") -> Column:
    """Whether a joined quote lies in the frame of so many minutes."""
    return F.expr(f"{ts} > release_ts AND {ts} {_before(bounds)} frame_end_{minutes}")


def smallest_frame(frames: Iterable[int], bounds: str = "open", ts: str = "ts") -> Column:
    """The shortest frame that holds a joined quote, or NULL outside all of them.

    Frames start together, so a frame holds exactly the quotes whose smallest
    frame is not longer than itself.
    """
    before = _before(bounds)
    cases = " ".join(
        f"WHEN {ts} {before} frame_end_{n} THEN {n}" for n in checked_frames(frames)
    )
    return F.expr(f"CASE WHEN {ts} <= release_ts THEN NULL {cases} END")
