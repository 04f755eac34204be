"""Minute bars: quotes reduced to the price points of whole minutes.

A bar is the partial result of one pair, day and minute. Quotes on the minute are kept apart (`edge`), so
bars tell every frame exactly. The quotes of minutes that no frame touches share one bar of the pair and day, which says no
more than that the pair was quoted. Everything after the bars works on at most some thousand rows for a
pair and day, whatever the number of quotes, frames and releases.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklens.functions.frames import (
    checked_frames,
    frame_of_minute,
    minute_band,
    minute_number,
    on_the_minute,
)
from ticklens.functions.points import PricePoint, aggregate_point
from ticklens.operators.calendar import WHOLE_DAY, FrameCalendar


def minute_aggregates(points: list[PricePoint]) -> list[Column]:
    """What a bar keeps for these points; two that share a partial result keep it once."""
    partials = {p.partial: p for p in points}
    return [c for p in partials.values() for c in aggregate_point(p, "minute IS NOT NULL")]


def minute_bars(
    ticks: DataFrame,
    calendar: FrameCalendar,
    points: list[PricePoint],
    quoted_days: DataFrame | None = None,
) -> DataFrame:
    """Bars (curr_pair, day, minute, edge, partial points) of the minutes that frames touch.

    The quotes are read once. Each input task sends on at most one row per bar, so a pair or a day that holds a
    third of all quotes makes no large group.

    Where a pair was quoted at all is read off the quotes of other minutes, unless `quoted_days` (curr_pair, day) tell it, as
    the partitions of a table do. Then other quotes are not aggregated, and with an `hour` column
    in the table not read where files are sorted by time.
    """
    prices = sorted({p.price for p in points})
    columns = ["curr_pair", "day", "ts", *prices]
    hours = calendar.in_hours() if quoted_days is not None and "hour" in ticks.columns else None
    quotes = ticks if hours is None else ticks.where(hours)
    near = calendar.near_quotes(quotes.select(*columns))
    if quoted_days is not None:
        near = near.where("near")
    bars = (
        near.withColumns(
            {
                "minute": F.when(F.col("near"), minute_number(F.col("ts"))),
                "edge": F.when(F.col("near"), on_the_minute()),
            }
        )
        .groupBy("curr_pair", "day", "minute", "edge")
        .agg(*minute_aggregates(points))
    )
    if quoted_days is None:
        return bars
    quoted = quoted_days.select("curr_pair", "day").distinct()
    return bars.unionByName(quoted, allowMissingColumns=True)


def release_bars(
    bars: DataFrame, calendar: FrameCalendar, frames: Iterable[int], bounds: str = "open"
) -> DataFrame:
    """Bars with the releases whose frames hold them and `segment`, the shortest such frame.

    One bar of every pair and day also meets all releases of the day, with segment NULL: a group without a
    quote in a frame keeps its row.
    """
    own_day = Window.partitionBy("curr_pair", "day").orderBy("minute", "edge")
    band = minute_band(F.col("minute"), calendar.longest)
    whole = F.when(F.row_number().over(own_day) == 1, F.lit(WHOLE_DAY).cast("bigint"))
    spread = bars.withColumn("bands", F.array(band, whole)).withColumn("band", F.explode("bands"))
    rows = calendar.broadcast_if_small(calendar.bands(whole_day=True), 3 * calendar.rows)
    met = (F.col("day") == F.col("trading_day")) & (F.col("band") == F.col("release_band"))
    inside = F.when(F.col("band") != WHOLE_DAY, frame_of_minute(checked_frames(frames), bounds))
    joined = spread.where("band IS NOT NULL").drop("bands").join(rows, met).withColumn("segment", inside)
    wanted = (F.col("band") == WHOLE_DAY) | F.col("segment").isNotNull()
    return joined.where(wanted).drop("band", "release_band", "minute", "edge", "release_minute")
