"""Prices of each pair after each release, for any list of time frames.

Quotes are reduced in two steps. The first makes minute bars (`bars`); nearly all rows go here, and their
cost depends neither on the number of frames nor on that of releases. The second step merges the
few bars that make up each frame of each release.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.functions.frames import checked_frames
from ticklens.functions.points import PricePoint, merge_point
from ticklens.functions.text import compact_time_label
from ticklens.operators.bars import minute_bars, release_bars
from ticklens.operators.calendar import FrameCalendar, frame_calendar
from ticklens.operators.join import frame_quotes, join_releases, latest_release_per_day
from ticklens.schemas import GROUP, RELEASE_FACTS, RELEASE_TIME

WIDE_GROUP = [*GROUP, *RELEASE_FACTS]


def frame_ticks(
    ticks: DataFrame, releases: DataFrame, minutes: int, bounds: str = "open"
) -> DataFrame:
    """The quotes inside the frame, with their release."""
    return frame_quotes(ticks, frame_calendar(releases, [minutes]), bounds)


def _facts(group: list[str]) -> list[str]:
    return [name for name in group if name in RELEASE_FACTS]


def segment_points(
    ticks: DataFrame,
    calendar: FrameCalendar,
    points: list[PricePoint],
    bounds: str = "open",
    group: list[str] = GROUP,
    quoted_days: DataFrame | None = None,
) -> DataFrame:
    """Price points per group and segment, the stretch between two frame ends.

    A group without a quote in a frame has a row with segment NULL.
    """
    bars = minute_bars(ticks, calendar, points, quoted_days)
    placed = release_bars(bars, calendar, calendar.frames, bounds)
    return merge_rows(placed, points, [*group, "segment"])


def merge_rows(segments: DataFrame, points: list[PricePoint], keys: list[str]) -> DataFrame:
    """Partial points of rows of the same keys merged into one row."""
    partials = {p.partial: p for p in points}
    best = [merge_point(p, "segment IS NOT NULL", f"best_{name}") for name, p in partials.items()]
    fields = [
        f"best_{name}.{part} AS {name}{suffix}"
        for name in partials
        for part, suffix in (("price", ""), ("ts", "_ts"))
    ]
    return segments.groupBy(*keys).agg(*best).selectExpr(*keys, *fields)


def merge_segments(
    segments: DataFrame,
    frames: Iterable[int],
    points: list[PricePoint],
    group: list[str] = GROUP,
    suffix: bool = True,
) -> DataFrame:
    """One row per group with the points of every frame; NULL where a frame has no quote.

    Segments of one group may come in several rows, as from several loads, or minute by minute.
    """
    minutes = checked_frames(frames)
    best = [merge_point(p, f"segment <= {n}", f"{p.partial}_{n}") for n in minutes for p in points]
    columns = [
        f"{p.partial}_{n}.{field} AS {name}" + (f"_{n}" if suffix else "")
        for n in minutes
        for p in points
        for field, name in (("price", p.price_name), ("ts", p.ts_name))
    ]
    return segments.groupBy(*group).agg(*best).selectExpr(*group, *columns)


def frame_points(
    ticks: DataFrame,
    releases: DataFrame,
    frames: Iterable[int],
    points: list[PricePoint],
    bounds: str = "open",
    group: list[str] = GROUP,
    suffix: bool = True,
    quoted_days: DataFrame | None = None,
) -> DataFrame:
    """Price points of every group and frame."""
    calendar = frame_calendar(releases, frames, _facts(group))
    bars = minute_bars(ticks, calendar, points, quoted_days)
    placed = release_bars(bars, calendar, calendar.frames, bounds)
    return merge_segments(placed, calendar.frames, points, group, suffix)


def with_labels(wide: DataFrame) -> DataFrame:
    """Replace the release time by the text key and the time label of the wide table."""
    points = [name for name in wide.columns if name not in WIDE_GROUP]
    return wide.select(
        F.concat("curr_pair", "day").alias("key0"),
        *RELEASE_FACTS,
        "curr_pair",
        "day",
        compact_time_label(F.col("trading_hour"), F.col("trading_min")).alias("time"),
        *points,
    )


def release_facts(ticks: DataFrame, releases: DataFrame) -> DataFrame:
    """The distinct releases each pair was quoted on."""
    quoted = ticks.select("curr_pair", "day").distinct()
    facts = releases.select(*RELEASE_TIME, *RELEASE_FACTS)
    return with_labels(join_releases(quoted, facts).select(*WIDE_GROUP).distinct())


def ticks_per_release(ticks: DataFrame, releases: DataFrame) -> DataFrame:
    """How many quotes each pair has on each release day."""
    per_day = ticks.groupBy("curr_pair", "day").agg(F.count("*").alias("n_ticks"))
    joined = join_releases(per_day, latest_release_per_day(releases))
    return joined.select("curr_pair", "day", "n_ticks")


def release_group_count(ticks: DataFrame, releases: DataFrame) -> DataFrame:
    """How many pairs and release days there are."""
    return ticks_per_release(ticks, releases).agg(F.count("*").alias("n_groups"))


def max_prices(
    ticks: DataFrame, releases: DataFrame, minutes: int, bounds: str = "half_open"
) -> DataFrame:
    """Highest ask and highest bid of a frame, each on its own."""
    highest = [
        PricePoint("high", price, f"max_{price}", f"max_{price}_ts") for price in ("ask", "bid")
    ]
    found = frame_points(ticks, releases, [minutes], highest, bounds, suffix=False)
    return found.drop(*(p.ts_name for p in highest))
