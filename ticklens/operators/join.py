"""Quotes matched with the releases of their day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.functions.frames import in_frame, minute_band, minute_number
from ticklens.operators.calendar import MAX_BROADCAST_BYTES, FrameCalendar, row_bytes
from ticklens.schemas import RELEASE_FACTS, RELEASE_TIME
from ticklens.session import new_dir

#: Quotes of one key that a shuffled join leaves together.
ROWS_PER_SPLIT = 1 << 22
_HOT_BYTES = 128


def hot_keys(
    quotes: DataFrame, keys: list[str], rows_per_split: int, max_broadcast_bytes: int
) -> DataFrame:
    """(keys, splits) of the keys that more quotes share than a split may hold, stored.

    The keys are counted where quotes are read. Not more than the total divided by the size of a split
    are hot, so a larger split keeps the list within the bound for whatever total.
    """
    counts = quotes.groupBy(*keys).agg(F.count("*").alias("n"))
    path = new_dir(quotes.sparkSession, "key_counts")
    counts.where(F.col("n") > rows_per_split).write.parquet(path)
    hot = quotes.sparkSession.read.schema(counts.schema).parquet(path)
    total = hot.agg(F.sum("n")).first()[0] or 0
    size = max(rows_per_split, -(-total * _HOT_BYTES // max_broadcast_bytes) if max_broadcast_bytes else 0)
    return hot.where(F.col("n") > size).select(*keys, F.ceil(F.col("n") / size).alias("splits"))


def join_releases(
    ticks: DataFrame,
    releases: DataFrame,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    rows: int | None = None,
    keys: dict[str, str] | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Inner join of quotes and releases on the day, or on `keys` (quote column: release column).

    `rows` is the number of releases, if it is known; else they are counted.

    A release calendar within the bound is broadcast: quotes stay where they are
    read, whatever share of them one day holds. A larger one is joined through a
    shuffle. Keys that hold many quotes are counted first and dealt out over as many
    splits as their share asks for; releases are copied for these keys only.
    """
    keys = keys or {"day": "trading_day"}
    same = [F.col(a) == F.col(b) for a, b in keys.items()]
    rows = releases.count() if rows is None else rows
    if rows * row_bytes(releases.schema) <= max_broadcast_bytes:
        # True of every day that can match. Spark prunes the partitions of a quote
        # table by the days of the calendar only if the calendar is filtered; naming
        # a second column keeps the condition from being tested on every quote.
        calendar = releases.where("trading_day >= '' OR trading_hour >= 0")
        return ticks.join(F.broadcast(calendar), _all(same))
    hot = hot_keys(ticks, list(keys), rows_per_split, max_broadcast_bytes)
    # The split of a quote depends on its values and input partition, so a task that runs again repeats it.
    place = F.xxhash64(F.spark_partition_id(), *ticks.columns)
    splits = F.coalesce("splits", F.lit(1))
    dealt = (
        ticks.join(F.broadcast(hot), list(keys), "left")
        .withColumn("split", F.pmod(place, splits))
        .drop("splits")
        .select(*ticks.columns, "split")
    )
    renamed = hot.withColumnsRenamed(keys)
    copied = releases.join(F.broadcast(renamed), list(keys.values()), "left").select(
        *releases.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), splits - 1)).alias("release_split")
    )
    met = _all([*same, F.col("split") == F.col("release_split")])
    return dealt.join(copied.hint("merge"), met).drop("split", "release_split")


def _all(conditions: list[Column]) -> Column:
    met = conditions[0]
    for condition in conditions[1:]:
        met &= condition
    return met


def frame_quotes(
    ticks: DataFrame, calendar: FrameCalendar, bounds: str = "open", rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """The quotes inside the longest frame, with each release whose frame holds them.

    Only quotes of touched minutes get as far as the join, which is on the day and on stretches of minutes: the
    rows grow with the quotes in frames, and not with the releases of a day.
    """
    near = calendar.near_quotes(ticks).where("near").drop("near")
    quotes = near.withColumn("band", minute_band(minute_number(F.col("ts")), calendar.longest))
    joined = join_releases(
        quotes,
        calendar.bands(whole_day=False),
        calendar.max_broadcast_bytes,
        rows=2 * calendar.rows,
        keys={"day": "trading_day", "band": "release_band"},
        rows_per_split=rows_per_split,
    )
    return joined.where(in_frame(calendar.longest, bounds)).drop("band", "release_band")


def tick_release_join(
    ticks: DataFrame,
    releases: DataFrame,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Each quote of a release day with the facts of that release."""
    facts = releases.select(*RELEASE_TIME, *RELEASE_FACTS)
    return join_releases(ticks, facts, max_broadcast_bytes, rows_per_split=rows_per_split)


def latest_release_per_day(releases: DataFrame) -> DataFrame:
    """One release per day: the last of the day, whichever order the rows come in."""
    later = ["trading_hour", "trading_min", *RELEASE_FACTS]
    return (
        releases.groupBy("trading_day")
        .agg(F.max(F.struct(*later)).alias("last"))
        .select("trading_day", "last.*")
    )
