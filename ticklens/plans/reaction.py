"""The reaction tables: one row per pair and release."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.functions.frames import checked_frames
from ticklens.functions.points import PricePoint, high_low, max_and_close, open_close
from ticklens.operators.calendar import frame_calendar
from ticklens.operators.clean import with_tick_ts
from ticklens.operators.reaction import (
    WIDE_GROUP,
    frame_points,
    merge_segments,
    segment_points,
    with_labels,
)
from ticklens.schemas import GROUP, RELEASE_FACTS, RELEASE_TIME
from ticklens.sinks.tables import create_database, quoted, save_table


def reaction(
    ticks: DataFrame,
    releases: DataFrame,
    minutes: int,
    points: list[PricePoint] | None = None,
    bounds: str = "open",
    quoted_days: DataFrame | None = None,
) -> DataFrame:
    """Points of a single frame, open and close of the ask by default."""
    single = frame_points(
        ticks,
        releases,
        [minutes],
        points or open_close(),
        bounds,
        suffix=False,
        quoted_days=quoted_days,
    )
    return single.select(F.concat("curr_pair", "day").alias("key"), *single.columns)


def reaction_high_low(
    ticks: DataFrame, releases: DataFrame, minutes: int, price: str = "ask"
) -> DataFrame:
    return reaction(ticks, releases, minutes, high_low(price))


def _keyed(ticks: DataFrame) -> DataFrame:
    """A quote without a pair has no key to appear under."""
    return ticks.where(F.col("curr_pair").isNotNull())


def reaction_wide(
    ticks: DataFrame,
    releases: DataFrame,
    frames: Iterable[int],
    points: list[PricePoint] | None = None,
    bounds: str = "open",
    quoted_days: DataFrame | None = None,
) -> DataFrame:
    """Release facts and the points of all frames side by side, from one pass over the quotes.

    `quoted_days` as in `operators.bars`: the partitions of the table, so that only quotes in frames are read.
    """
    quoted = None if quoted_days is None else _keyed(quoted_days)
    return with_labels(
        frame_points(
            _keyed(ticks),
            releases,
            frames,
            points or open_close(),
            bounds,
            WIDE_GROUP,
            quoted_days=quoted,
        )
    )


def reaction_wide_chained(
    ticks: DataFrame,
    releases: DataFrame,
    frames: Iterable[int],
    stage_dir: str,
    points: list[PricePoint] | None = None,
    bounds: str = "open",
) -> DataFrame:
    """The same table, put together by joining one table per frame.

    The segments are written once to `stage_dir`, so the quotes are still read only
    once; all joined tables have a row per pair and release.
    """
    points = points or open_close()
    spark = ticks.sparkSession
    calendar = frame_calendar(releases, frames, RELEASE_FACTS)
    staged = segment_points(_keyed(ticks), calendar, points, bounds, WIDE_GROUP)
    staged.write.mode("overwrite").parquet(stage_dir)
    segments = spark.read.schema(staged.schema).parquet(stage_dir)
    tables = []
    for n in checked_frames(frames):
        one = merge_segments(segments, [n], points)
        tables.append(one.select(_text_key().alias("key"), *one.columns[len(GROUP) :]))
    facts = segments.select(_text_key().alias("key"), *WIDE_GROUP).distinct()
    chained = reduce(lambda left, right: left.join(right, "key"), tables, facts)
    return with_labels(chained.drop("key"))


def _text_key() -> Column:
    """Pair, day and release time as one text; two releases of a day differ in it."""
    clock = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("trading_hour", "trading_min")]
    return F.concat_ws(" ", "curr_pair", "day", *clock)


def price_summary_wide(
    ticks: DataFrame,
    releases: DataFrame,
    frames: Iterable[int],
    bounds: str = "half_open",
    quoted_days: DataFrame | None = None,
) -> DataFrame:
    """Maximum and close of ask and bid, with times, for every frame."""
    return frame_points(
        ticks, releases, frames, max_and_close(), bounds, WIDE_GROUP, quoted_days=quoted_days
    )


#: What the packaged job can report of a frame.
POINTS = {"open_close": open_close, "high_low": high_low, "ohlc": lambda p: open_close(p) + high_low(p)}


def run_reaction_job(
    spark: SparkSession,
    db: str,
    table: str,
    frames: Iterable[int],
    ticks_table: str = "tick_data",
    releases_table: str = "releases",
    mode: str = "errorifexists",
    files: int | None = None,
    price: str = "ask",
    points: str = "open_close",
    bounds: str | None = None,
    path: str | None = None,
) -> str:
    """Build a result table from two catalog tables and save it as a third; return its name.

    `points` names what is reported of `price`, or is `summary`: maximum and close of ask and bid.
    `bounds` is open, or half-open for the summary, unless given. The quote table may carry `ts` or only the day and
    the clock fields. With `path` the result is an external table.
    """
    quotes = spark.table(quoted(f"{db}.{ticks_table}"))
    if "ts" not in quotes.columns:
        quotes = with_tick_ts(quotes)
    calendar = spark.table(quoted(f"{db}.{releases_table}"))
    if "previous" not in calendar.columns:  # older tables spell it in another way
        calendar = calendar.withColumnRenamed("previoius", "previous")
    releases = calendar.select(*RELEASE_TIME, *RELEASE_FACTS)
    if points == "summary":
        result = price_summary_wide(quotes, releases, frames, bounds or "half_open")
    else:
        result = reaction_wide(quotes, releases, frames, POINTS[points](price), bounds or "open")
    create_database(spark, db)
    save_table(result, f"{db}.{table}", mode, files, path)
    return f"{db}.{table}"
