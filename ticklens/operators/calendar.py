"""A release calendar prepared for time frames: which minutes of which days its frames touch.

Releases are set for whole minutes and frames last whole minutes, so the quotes of a frame are those of
whole minutes, but for the instants at which a frame starts or ends. All that a quote has to be asked
is therefore whether its minute is touched by any frame of its day. The answer is one bit out
of 1440 for a day, however many releases the day has: the bitmaps of a calendar are bounded by its
days, not by its releases.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.functions.frames import checked_frames, minute_number, with_frame_ends
from ticklens.schemas import RELEASE_TIME

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
DAY_MINUTES = 1440
_WORD = 64
_WORDS = -(-DAY_MINUTES // _WORD)
#: Bytes of one broadcast day: its bitmap, its name and what Spark adds.
DAY_BYTES = 8 * _WORDS + 120
#: The band of the row that every release has for all quotes of its day.
WHOLE_DAY = -1


def row_bytes(schema: T.StructType) -> int:
    """A generous size of one broadcast row: the typed release columns are all short."""
    return 32 + sum(64 if isinstance(f.dataType, T.StringType) else 16 for f in schema)


@dataclass(frozen=True)
class FrameCalendar:
    """Releases with frames of up to `longest` minutes; the figures are computed once."""

    #: The release columns, `release_ts`, the frame ends, and `release_minute`.
    releases: DataFrame
    frames: tuple[int, ...]
    rows: int
    days: int
    #: Hours of the day that any frame touches.
    hours: tuple[int, ...]
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES

    @property
    def longest(self) -> int:
        return self.frames[-1]

    def touched(self) -> DataFrame:
        """(touched_day, touched_minutes): a bitmap for every day of the calendar."""
        minute = F.explode_outer(_touched_minutes(self.longest)).alias("minute")
        at = F.col("minute")
        bit = F.expr(f"shiftleft(1L, CAST(minute % {_WORD} AS INT))")
        words = [
            F.bit_or(F.when((at >= w * _WORD) & (at < (w + 1) * _WORD), bit)) for w in range(_WORDS)
        ]
        bitmap = F.array(*(F.coalesce(w, F.lit(0).cast("bigint")) for w in words))
        return (
            self.releases.select("trading_day", "trading_hour", "release_minute")
            # Spark prunes the partitions of a quote table by the days of the calendar only if the
            # calendar is filtered; a second column keeps the condition from being tested on quotes.
            .where("trading_day >= '' OR trading_hour >= 0")
            .select("trading_day", minute)
            .groupBy(F.col("trading_day").alias("touched_day"))
            .agg(bitmap.alias("touched_minutes"))
        )

    def bands(self, whole_day: bool) -> DataFrame:
        """Releases by `release_band`: the two stretches of `longest` minutes that their frames touch.

        With `whole_day` each has a further row, of band WHOLE_DAY.
        """
        first, last = (
            F.floor((F.col("release_minute") + n) / self.longest) for n in (0, self.longest)
        )
        near = F.coalesce(F.sequence(first, last), F.array().cast("array<bigint>"))
        if whole_day:
            near = F.concat(F.array(F.lit(WHOLE_DAY).cast("bigint")), near)
        return self.releases.withColumn("release_band", F.explode(near))

    def broadcast_if_small(self, df: DataFrame, rows: int) -> DataFrame:
        small = rows * row_bytes(df.schema) <= self.max_broadcast_bytes
        return F.broadcast(df) if small else df

    def near_quotes(self, quotes: DataFrame) -> DataFrame:
        """Quotes of the calendar's days, with `near`: whether their minute is touched by a frame.

        This is a broadcast join of at most one row per day; quotes stay where they are read. A calendar of more days than
        fit the bound (some 700 years) keeps all quotes, and takes all minutes for touched.
        """
        if self.days * DAY_BYTES > self.max_broadcast_bytes:
            return quotes.withColumn("near", F.col("ts").isNotNull())
        of_day = "(hour(ts) * 60 + minute(ts))"
        word = f"get(touched_minutes, CAST({of_day} DIV {_WORD} AS INT))"
        bit = f"getbit({word}, {of_day} % {_WORD}) = 1"
        joined = quotes.join(F.broadcast(self.touched()), F.col("day") == F.col("touched_day"))
        return joined.withColumn("near", F.coalesce(F.expr(bit), F.lit(False))).drop(
            "touched_day", "touched_minutes"
        )

    def in_hours(self) -> Column | None:
        """A condition on the hour column of stored quotes, for the files to be skipped by; None if all hours are touched."""
        return None if len(self.hours) == 24 else F.col("hour").isin(list(self.hours))


def _touched_minutes(longest: int) -> Column:
    """Minutes of the day, from the release on, to the end of the longest frame or of the day."""
    first = F.pmod(F.col("release_minute"), F.lit(DAY_MINUTES))
    return F.sequence(first, F.least(first + longest, F.lit(DAY_MINUTES - 1).cast("bigint")))


def frame_calendar(
    releases: DataFrame,
    frames: Iterable[int],
    facts: Iterable[str] = (),
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> FrameCalendar:
    """Prepare a calendar: one small aggregation, whatever is joined with it afterwards."""
    minutes = checked_frames(frames)
    timed = with_frame_ends(releases.select(*RELEASE_TIME, *facts), minutes)
    timed = timed.withColumn("release_minute", minute_number(F.col("release_ts")))
    hours = F.array_distinct(F.transform(_touched_minutes(minutes[-1]), lambda m: (m / 60).cast("int")))
    per_day = (
        timed.select("trading_day", hours.alias("hours"))
        .groupBy("trading_day")
        .agg(F.count("*").alias("n"), F.flatten(F.collect_set("hours")).alias("hours"))
    )
    # What is collected are 24 numbers at most for each distinct set of hours.
    found = per_day.agg(
        F.sum("n").alias("rows"),
        F.count("trading_day").alias("days"),
        F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.array_distinct("hours"))))).alias("hours"),
    ).first()
    return FrameCalendar(
        timed,
        tuple(minutes),
        found["rows"] or 0,
        found["days"],
        tuple(sorted(found["hours"])),
        max_broadcast_bytes,
    )
