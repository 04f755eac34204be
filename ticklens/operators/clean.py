"""From raw text tables to typed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.functions import text
from ticklens.schemas import RELEASES, TICKS


def clean_ticks(raw: DataFrame) -> DataFrame:
    """Split the quote time into day and clock fields and add the timestamp.

    Bid and ask are taken by name.
    """
    parts = text.tick_parts(F.col("trade_dt"))
    return raw.withColumns(parts).withColumn("ts", text.tick_timestamp(F.col("trade_dt"))).select(
        *TICKS.names
    )


def with_tick_ts(ticks: DataFrame) -> DataFrame:
    """Add `ts` to a quote table that has only the day and the clock fields."""
    fields = [F.col(name) for name in ("day", "hour", "min", "sec", "milli")]
    return ticks.withColumn("ts", text.day_clock_timestamp(*fields))


def clean_releases(raw: DataFrame) -> DataFrame:
    """Typed releases without the header rows; a row without a time is dropped as well."""
    return (
        raw.where(F.col("release_time") != text.HEADER_TIME)
        .withColumns({name: text.figure(F.col(name)) for name in ("actual", "forecast", "previous")})
        .withColumns(
            {
                "trading_day": text.release_day(F.col("release_date")),
                "trading_hour": text.int_part(F.col("release_time"), 1, 2),
                "trading_min": text.int_part(F.col("release_time"), 4, 2),
            }
        )
        .select(*RELEASES.names)
    )


def release_history(releases: DataFrame) -> DataFrame:
    """The release view: day, time label and figures."""
    return releases.select(
        "trading_day",
        text.time_label(F.col("trading_hour"), F.col("trading_min")).alias("trading_time"),
        "actual",
        "forecast",
        "previous",
    )


def release_surprise(history: DataFrame) -> DataFrame:
    """How far each figure is from its forecast and from the previous one."""
    return history.select(
        "trading_day",
        "trading_time",
        "actual",
        (F.col("actual") - F.col("forecast")).alias("diff_forecast"),
        (F.col("actual") - F.col("previous")).alias("diff_previous"),
    )
