"""Incremental reaction tables.

Segment points are minima and maxima, so the points of a new file and those of
all earlier ones merge into the points of both, in any order and as often as one
likes. `load_increment` uses that: every micro-batch reduces its own quotes and
appends the result, and a reader merges what is there. No state grows, no quote
is too late, and a batch that runs twice changes nothing.

The store (`store`) also keeps the calendar. `change_calendar` compares it with a new one, computes the
segments of new releases from the quotes at rest of their days, and leaves out those of releases that
are gone. `compact` merges the rows of all loads into a few files.

`closed_frames` and `segment_stream` are the stateful forms, for consumers that want results
pushed to them.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.functions.frames import (
    checked_frames,
    in_frame,
    minute_band,
    minute_number,
    smallest_frame,
    with_frame_ends,
)
from ticklens.functions.points import PricePoint, aggregate_point
from ticklens.operators.calendar import frame_calendar
from ticklens.operators.join import join_releases
from ticklens.operators.reaction import merge_rows, merge_segments, segment_points
from ticklens.schemas import GROUP, PRICE, RELEASE_FACTS, RELEASE_TIME, RELEASES
from ticklens.streaming.store import ADD, CALENDAR, SegmentStore


def _series(
    segments_dir: str, frames: Iterable[int], bounds: str, points: list[PricePoint]
) -> str:
    """Segments depend on frames, bounds and points, so every choice has its own directory."""
    choice = "-".join([bounds, *map(str, checked_frames(frames))])
    return f"{segments_dir}/{choice}/" + "-".join(sorted({p.partial for p in points}))


def _segment_schema(points: list[PricePoint]) -> T.StructType:
    kinds = {"trading_hour": T.IntegerType(), "trading_min": T.IntegerType()}
    keys = [T.StructField(name, kinds.get(name, T.StringType())) for name in GROUP]
    fields = [T.StructField("segment", T.IntegerType())]
    for name in dict.fromkeys(p.partial for p in points):
        fields += [T.StructField(name, PRICE), T.StructField(f"{name}_ts", T.TimestampNTZType())]
    return T.StructType(keys + fields)


def segment_store(
    spark: SparkSession,
    segments_dir: str,
    frames: Iterable[int],
    points: list[PricePoint],
    bounds: str = "open",
) -> SegmentStore:
    """The store of the segments of these frames, bounds and points."""
    return SegmentStore(spark, _series(segments_dir, frames, bounds, points), _segment_schema(points))


def load_increment(
    ticks_stream: DataFrame,
    releases: DataFrame,
    frames: Iterable[int],
    points: list[PricePoint],
    segments_dir: str,
    checkpoint_dir: str,
    bounds: str = "open",
) -> None:
    """Reduce the quotes that have arrived since the last call and append their segments.

    The first load gives the store its calendar, which is prepared once, before the stream starts. Later ones must come with
    the same release times, or those that `change_calendar` has set.
    """
    spark = ticks_stream.sparkSession
    store = segment_store(spark, segments_dir, frames, points, bounds)
    kept = _calendar(store)
    if kept is None:
        name = store.write(releases.select(*RELEASES.names))
        store.commit(store.state().generation, [(CALENDAR, name, "")])
        kept = store.read_names([name], RELEASES)
    elif not (_without(releases, kept).isEmpty() and _without(kept, releases).isEmpty()):
        raise ValueError("the release times have changed; call change_calendar first")
    calendar = frame_calendar(kept, frames)

    def append(batch: DataFrame, batch_id: int) -> None:
        # Every attempt writes rows of its own; that a repeated batch adds its rows again changes no minimum.
        store.append(segment_points(batch, calendar, points, bounds).select(store.schema.names), f"batch {batch_id}")

    query = (
        ticks_stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _calendar(store: SegmentStore) -> DataFrame | None:
    """The calendar that the store keeps."""
    kept = store.state().calendar
    return None if kept is None else store.read_names([kept], RELEASES)


def change_calendar(
    ticks: DataFrame,
    releases: DataFrame,
    frames: Iterable[int],
    points: list[PricePoint],
    segments_dir: str,
    bounds: str = "open",
) -> None:
    """Make `releases` the calendar of the store and add what its new releases need.

    `ticks` are the quotes at rest that have been loaded. Only the days of new releases are read of them, if they are partitioned
    by day. Segments and calendar become visible together.
    """
    spark = ticks.sparkSession
    store = segment_store(spark, segments_dir, frames, points, bounds)
    state = store.state()
    before = _calendar(store)
    wanted = releases.select(*RELEASES.names)
    entries = [(CALENDAR, store.write(wanted), "")]
    version = store.read_names([entries[0][1]], RELEASES)
    added = version if before is None else _without(version, before)
    if not added.isEmpty():
        calendar = frame_calendar(added, frames)
        found = segment_points(ticks, calendar, points, bounds).select(store.schema.names)
        entries.append((ADD, store.write(found), "late releases"))
    store.commit(state.generation, entries)


def _without(releases: DataFrame, others: DataFrame) -> DataFrame:
    """Releases whose day and time `others` do not have."""
    times = others.select(*(F.col(c).alias(f"old_{c}") for c in RELEASE_TIME)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in RELEASE_TIME]
    return releases.join(times, same, "left_anti")


def _current(store: SegmentStore, segments: DataFrame, calendar: DataFrame | None) -> DataFrame:
    """Segments of releases that are still in the calendar."""
    if calendar is None:
        return segments
    times = calendar.select(*RELEASE_TIME).distinct()
    same = [
        F.col("day") == F.col("trading_day"),
        *(segments[c].eqNullSafe(times[c]) for c in RELEASE_TIME[1:]),
    ]
    return segments.join(times, same, "left_semi")


def read_increments(
    spark: SparkSession,
    segments_dir: str,
    frames: Iterable[int],
    points: list[PricePoint],
    bounds: str = "open",
    suffix: bool = True,
) -> DataFrame:
    """The points of all quotes loaded so far with these frames and bounds; empty if there are none."""
    frames = checked_frames(frames)
    store = segment_store(spark, segments_dir, frames, points, bounds)
    segments = _current(store, store.read(), _calendar(store))
    return merge_segments(segments, frames, points, GROUP, suffix)


def read_increments_wide(
    spark: SparkSession,
    releases: DataFrame,
    segments_dir: str,
    frames: Iterable[int],
    points: list[PricePoint],
    bounds: str = "open",
) -> DataFrame:
    """The same with the facts of the releases, which may have been corrected since the load."""
    merged = read_increments(spark, segments_dir, frames, points, bounds)
    facts = releases.select(*RELEASE_TIME, *RELEASE_FACTS).distinct()
    met = [
        F.col("day") == facts["trading_day"],
        *(merged[c].eqNullSafe(facts[c]) for c in RELEASE_TIME[1:]),
    ]
    points_only = [c for c in merged.columns if c not in GROUP]
    group = [merged[c] for c in GROUP]
    return merged.join(facts, met).select(*group, *RELEASE_FACTS, *points_only)


def compact(
    spark: SparkSession,
    segments_dir: str,
    frames: Iterable[int],
    points: list[PricePoint],
    bounds: str = "open",
    files: int = 1,
) -> int:
    """Merge the segments of all loads into so many files; returns how many directories were dropped.

    Segments of releases that are no longer in the calendar go. Readers see the rows before or after, which are the same.
    """
    store = segment_store(spark, segments_dir, frames, points, bounds)
    state = store.state()
    if state.names:
        segments = _current(store, store.read(state), _calendar(store))
        merged = merge_rows(segments, points, [*GROUP, "segment"])
        store.replace(state, merged.select(store.schema.names), files)
    return store.vacuum()


def _checked_zone(spark: SparkSession) -> None:
    """Time stamps without a zone cannot carry a watermark."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError(f"a watermark needs the session zone UTC, not {zone}")


def _partials(points: list[PricePoint], where: str) -> list[Column]:
    found = {p.partial: p for p in points}
    return [c for p in found.values() for c in aggregate_point(p, where)]


def closed_frames(
    ticks_stream: DataFrame,
    releases: DataFrame,
    frames: Iterable[int],
    points: list[PricePoint],
    delay: timedelta = timedelta(0),
    bounds: str = "open",
) -> DataFrame:
    """Append-mode stream of (pair, day, release time, frame, points): each frame once, as soon as it is over.

    A frame is over when a quote is seen that is later than its end by more than `delay`; its state is dropped then, and
    quotes of it that come later still are ignored. The watermark is on the end of frames. To let it follow the quotes, each of
    them also brings a time of its own, as far ahead as the longest frame can reach, and the watermark stays
    behind by as much; these rows end before the state. Only frames with a quote are reported.
    """
    _checked_zone(ticks_stream.sparkSession)
    minutes = checked_frames(frames)
    longest = timedelta(minutes=minutes[-1])
    calendar = frame_calendar(releases, minutes)
    rows = calendar.broadcast_if_small(calendar.bands(whole_day=False), 2 * calendar.rows)
    prices = sorted({p.price for p in points})
    quotes = ticks_stream.select("curr_pair", "day", "ts", *prices).where(F.col("ts").isNotNull())
    band = minute_band(minute_number(F.col("ts")), calendar.longest)
    met = (F.col("day") == F.col("trading_day")) & (F.col("band") == F.col("release_band"))
    joined = quotes.withColumn("band", band).join(rows, met, "left")
    ends = [
        F.when(
            in_frame(n, bounds),
            F.struct(F.lit(n).alias("frame"), F.col(f"frame_end_{n}").alias("closes")),
        )
        for n in minutes
    ]
    own = F.struct(F.lit(None).cast("int").alias("frame"), (F.col("ts") + F.lit(longest)).alias("closes"))
    held = F.explode(F.filter(F.array(*ends, own), lambda e: e.isNotNull())).alias("held")
    placed = joined.select("*", held).select(
        *GROUP, "ts", *prices, "held.frame", F.col("held.closes").cast("timestamp").alias("closes")
    )
    behind = int((longest + delay).total_seconds() * 1_000_000)
    # One condition that names `closes`, so that it is not moved below the watermark.
    in_a_frame = F.expr("CASE WHEN frame IS NULL THEN false ELSE closes IS NOT NULL END")
    return (
        placed.withWatermark("closes", f"{behind} microseconds")
        .where(in_a_frame)
        .groupBy(*GROUP, "frame", "closes")
        .agg(*_partials(points, "TRUE"))
        .select(
            *GROUP,
            "frame",
            *(F.col(f"{p.partial}").alias(p.price_name) for p in points),
            *(F.col(f"{p.partial}_ts").alias(p.ts_name) for p in points),
        )
    )


def segment_stream(
    ticks_stream: DataFrame,
    releases: DataFrame,
    frames: Iterable[int],
    points: list[PricePoint],
    bounds: str = "open",
    watermark: str | None = None,
) -> DataFrame:
    """Segment points as a streaming aggregation.

    With a watermark, the state of a day is dropped once the day and the delay are
    over, and append mode emits each group then; quotes that come later still are
    ignored, so leave it out when history is loaded in any order. Time stamps
    without a zone cannot carry a watermark: set the session zone to UTC.
    """
    if watermark:
        _checked_zone(ticks_stream.sparkSession)
    prices = sorted({p.price for p in points})
    calendar = with_frame_ends(releases.select(*RELEASE_TIME), frames)
    ticks = ticks_stream.select("curr_pair", "day", "ts", *prices)
    keys = [*map(F.col, GROUP), F.col("segment")]
    if watermark:
        ticks = ticks.withColumn("event_time", F.col("ts").cast("timestamp"))
        ticks = ticks.withWatermark("event_time", watermark)
        keys.append(F.window("event_time", "1 day"))
    return (
        join_releases(ticks, calendar)
        .withColumn("segment", smallest_frame(frames, bounds))
        .groupBy(*keys)
        .agg(*_partials(points, "segment IS NOT NULL"))
        .drop("window")
    )
