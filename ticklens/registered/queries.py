"""One function per registered query: (session, data directory) -> DataFrame.

Quotes are a projection of the `events` table. The release calendar is loaded
into a typed table in the shared folder first, as in production, so that its
size is known before it is joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.functions import text
from ticklens.functions.frames import with_frame_ends
from ticklens.functions.points import high_low, open_close, point
from ticklens.operators import chunks, clean, gaps, join
from ticklens.operators import reaction as ops
from ticklens.operators.calendar import frame_calendar
from ticklens.plans import load, reaction
from ticklens.schemas import RELEASE_FACTS, RELEASE_TIME
from ticklens.session import new_dir
from ticklens.sinks import tables as sinks
from ticklens.sources import files, from_events, tables
from ticklens.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

# The layout and the frames of the original jobs.
_BY_PAIR = ("curr_pair",)
SHORT_FRAMES = [1, 2, 3, 4, 5]
SCRIPT_FRAMES = [1, 5, 10, 20]
SUMMARY_FRAMES = [1, 5, 15, 60]

_queries: dict[str, Query] = {}


def _register(query: Query) -> Query:
    _queries[query.__name__] = query
    return query


def all_queries() -> dict[str, Query]:
    return dict(_queries)


# Inputs


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events.ticks_of(from_events.events(spark, sf_dir))


def _raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events.raw_ticks_of(from_events.events(spark, sf_dir))


def _raw_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events.raw_releases_of(from_events.events(spark, sf_dir))


def _stored_releases(spark: SparkSession, raw: DataFrame) -> DataFrame:
    path = new_dir(spark, "releases")
    sinks.write_releases(clean.clean_releases(raw), path)
    return tables.read_releases(spark, path)


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_releases(spark, _raw_releases(spark, sf_dir))


def _two_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_releases(spark, sf_dir)
    return _stored_releases(spark, from_events.with_second_release(raw))


def _stored_gap_lines(spark: SparkSession, sf_dir: str) -> str:
    path = new_dir(spark, "gaps")
    lines = from_events.gap_lines_of(from_events.events(spark, sf_dir))
    lines.write.partitionBy("curr_pair").text(path)
    return path


# Sources


@_register
def scan_ticks_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "ticks_csv")
    _raw_ticks(spark, sf_dir).write.partitionBy("curr_pair").csv(path, sep=files.TICK_DELIMITER)
    return files.read_raw_ticks(spark, path)


@_register
def scan_releases_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "releases_csv")
    raw = from_events.with_header(_raw_releases(spark, sf_dir))
    raw.write.csv(path, sep=files.RELEASE_DELIMITER, emptyValue="")
    return files.read_raw_releases(spark, path)


@_register
def scan_ticks_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "ticks")
    sinks.write_ticks(clean.clean_ticks(_raw_ticks(spark, sf_dir)), path, _BY_PAIR, rebalance=False)
    tables.read_ticks(spark, path).createOrReplaceTempView("tick_data")
    return tables.read_table(
        spark, "tick_data", ["day", "hour", "min", "sec", "milli", "bid", "ask", "curr_pair"]
    )


# Sinks


@_register
def write_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = new_dir(spark, "releases_csv"), new_dir(spark, "releases")
    raw = from_events.with_header(_raw_releases(spark, sf_dir))
    raw.write.csv(source, sep=files.RELEASE_DELIMITER, emptyValue="")
    load.load_releases(spark, source, target)
    return tables.read_releases(spark, target)


@_register
def write_ticks_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pairs, then one pair again: the others stay."""
    path = new_dir(spark, "ticks")
    ticks = clean.clean_ticks(_raw_ticks(spark, sf_dir))
    sinks.write_ticks(ticks, path, _BY_PAIR, rebalance=False)
    sinks.write_ticks(ticks.where(F.col("curr_pair") == "EURUSD"), path, _BY_PAIR, rebalance=False)
    return tables.read_ticks(spark, path).drop("ts")


def _feeds_with_bad_lines(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """Directories of quotes, releases and gap reports in which some lines are bad and some occur twice."""
    source = from_events.events(spark, sf_dir)
    ticks, releases, reports = (new_dir(spark, n) for n in ("ticks_csv", "releases_csv", "gaps"))
    _raw_ticks(spark, sf_dir).write.partitionBy("curr_pair").csv(ticks, sep=files.TICK_DELIMITER)
    bad = from_events.bad_tick_lines_of(source)
    bad.write.mode("append").partitionBy("curr_pair").text(ticks)
    raw = from_events.with_header(_raw_releases(spark, sf_dir))
    raw.write.csv(releases, sep=files.RELEASE_DELIMITER, emptyValue="")
    far = raw.withColumn("actual", F.lit("99999999999K"))
    far.write.mode("append").csv(releases, sep=files.RELEASE_DELIMITER, emptyValue="")
    lines = from_events.gap_lines_of(source)
    lines = lines.unionByName(lines.where(F.col("curr_pair") == "EURUSD"))
    lines.unionByName(from_events.bad_gap_lines_of(source)).write.partitionBy("curr_pair").text(reports)
    return ticks, releases, reports


@_register
def load_checked_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "ticks")
    source = _feeds_with_bad_lines(spark, sf_dir)[0]
    load.load_ticks(spark, source, path, rejects=new_dir(spark, "rejects"))
    return tables.read_ticks(spark, path).drop("ts")


@_register
def load_checked_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "releases")
    source = _feeds_with_bad_lines(spark, sf_dir)[1]
    load.load_releases(spark, source, path, rejects=new_dir(spark, "rejects"))
    return tables.read_releases(spark, path)


@_register
def load_checked_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with lines that occur twice: they stay two."""
    path = new_dir(spark, "gap_table")
    source = _feeds_with_bad_lines(spark, sf_dir)[2]
    load.load_gap_table(spark, source, path, new_dir(spark, "rejects"))
    return tables.read_gaps(spark, path)


@_register
def load_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the loads of all feeds reject, and why."""
    ticks, releases, reports = _feeds_with_bad_lines(spark, sf_dir)
    rejects = new_dir(spark, "rejects")
    load.load_ticks(spark, ticks, new_dir(spark, "ticks"), rejects=rejects)
    load.load_releases(spark, releases, new_dir(spark, "releases"), rejects=rejects)
    load.load_gap_table(spark, reports, new_dir(spark, "gap_table"), rejects)
    found = tables.read_rejects(spark, rejects)
    return found.groupBy("feed", "curr_pair", "reason").agg(F.count("*").alias("n"))


def _database(spark: SparkSession) -> str:
    """A database of its own in the shared folder; its files outlive its names."""
    location = new_dir(spark, "db")
    db = "fx_" + location.rsplit("-", 1)[1]
    sinks.create_database(spark, db, location)
    return db


def _forget(spark: SparkSession, db: str, *names: str) -> None:
    """Drop the names of external tables and views; a frame that reads their files goes on."""
    for name in names:
        kind = "VIEW" if spark.catalog.getTable(f"{db}.{name}").tableType == "VIEW" else "TABLE"
        spark.sql(f"DROP {kind} {sinks.quoted(f'{db}.{name}')}")
    spark.sql(f"DROP DATABASE {sinks.quoted(db)}")


def _external(spark: SparkSession, df: DataFrame, db: str, name: str) -> None:
    path = new_dir(spark, name)
    df.write.parquet(path)
    sinks.register_table(spark, f"{db}.{name}", path, df.schema)


@_register
def write_reaction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packaged job: two catalog tables in, a third one out."""
    db = _database(spark)
    _external(spark, _ticks(spark, sf_dir), db, "tick_data")
    _external(spark, clean.clean_releases(_raw_releases(spark, sf_dir)), db, "releases")
    out = new_dir(spark, "prices_1_to_5")
    name = reaction.run_reaction_job(spark, db, "prices_1_to_5", SHORT_FRAMES, files=1, path=out)
    result = spark.read.schema(spark.table(name).schema).parquet(out)
    _forget(spark, db, "tick_data", "releases", "prices_1_to_5")
    return result


@_register
def write_summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packaged job with other prices, points and bounds."""
    db = _database(spark)
    _external(spark, _ticks(spark, sf_dir), db, "tick_data")
    _external(spark, clean.clean_releases(_raw_releases(spark, sf_dir)), db, "releases")
    out = new_dir(spark, "summary")
    name = reaction.run_reaction_job(
        spark, db, "summary", SUMMARY_FRAMES, files=1, path=out, points="summary", bounds="half_open"
    )
    result = spark.read.schema(spark.table(name).schema).parquet(out)
    _forget(spark, db, "tick_data", "releases", "summary")
    return result


@_register
def release_history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as the catalog stores it, read by another session than the one that made it."""
    db = _database(spark)
    _external(spark, clean.clean_releases(_raw_releases(spark, sf_dir)), db, "releases")
    sinks.create_release_view(spark, f"{db}.release_history", f"{db}.releases")
    shown = spark.newSession().table(f"{db}.release_history")
    history = spark.table(f"{db}.release_history")
    assert shown.schema == history.schema
    _forget(spark, db, "release_history", "releases")
    return history


# Parsing and cleaning


@_register
def tick_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_ticks(_raw_ticks(spark, sf_dir)).drop("ts")


@_register
def tick_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_ticks(spark, sf_dir).select(
        "curr_pair", "trade_dt", text.tick_timestamp(F.col("trade_dt")).alias("tick_ts")
    )


@_register
def release_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_releases(from_events.with_header(_raw_releases(spark, sf_dir)))


@_register
def release_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    releases = clean.clean_releases(_raw_releases(spark, sf_dir))
    return with_frame_ends(releases.select(*RELEASE_TIME), SHORT_FRAMES)


@_register
def release_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.release_surprise(release_history_view(spark, sf_dir))


@_register
def pair_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "ticks")
    sinks.write_ticks(clean.clean_ticks(_raw_ticks(spark, sf_dir)), path, _BY_PAIR, rebalance=False)
    ticks = tables.read_ticks(spark, path).where(F.col("curr_pair") == "EURUSD")
    return ticks.select("curr_pair", "day", "hour", "min", "sec", "milli", "bid", "ask")


# Joins


_JOINED = [
    *("day", "hour", "min", "sec", "milli", "bid", "ask", "curr_pair"),
    *("trading_day", "trading_hour", "trading_min", "previous", "forecast", "actual"),
]


@_register
def tick_release_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = clean.clean_ticks(_raw_ticks(spark, sf_dir))
    return join.tick_release_join(ticks, _releases(spark, sf_dir)).select(*_JOINED)


@_register
def tick_release_join_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of a calendar beyond the broadcast bound, with days split by their share of the quotes."""
    ticks = clean.clean_ticks(_raw_ticks(spark, sf_dir))
    joined = join.tick_release_join(
        ticks, _releases(spark, sf_dir), max_broadcast_bytes=4096, rows_per_split=1000
    )
    return joined.select(*_JOINED)


@_register
def tick_release_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair, and of several releases on a day the last."""
    ticks = clean.clean_ticks(_raw_ticks(spark, sf_dir)).where(F.col("curr_pair") == "EURUSD")
    releases = join.latest_release_per_day(_two_releases(spark, sf_dir))
    return join.tick_release_join(ticks, releases).select(*_JOINED)


def _edge_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events.edge_ticks_of(from_events.events(spark, sf_dir))


def _frame_ticks(spark: SparkSession, sf_dir: str, bounds: str, quotes=_ticks) -> DataFrame:
    rows = ops.frame_ticks(quotes(spark, sf_dir), _releases(spark, sf_dir), 60, bounds)
    return rows.select("curr_pair", "day", "trading_hour", "trading_min", "ts", "bid", "ask")


@_register
def frame_ticks_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_ticks(spark, sf_dir, "open")


@_register
def frame_ticks_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_ticks(spark, sf_dir, "half_open")


@_register
def frame_ticks_edges_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_ticks(spark, sf_dir, "open", _edge_ticks)


@_register
def frame_ticks_edges_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_ticks(spark, sf_dir, "half_open", _edge_ticks)


# Single frames


def _reaction(spark: SparkSession, sf_dir: str, minutes: int, points=None, bounds="open"):
    ticks, releases = _ticks(spark, sf_dir), _releases(spark, sf_dir)
    return reaction.reaction(ticks, releases, minutes, points, bounds)


@_register
def reaction_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reaction(spark, sf_dir, 1)


@_register
def reaction_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reaction(spark, sf_dir, 5)


@_register
def reaction_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reaction(spark, sf_dir, 15)


@_register
def reaction_60m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reaction(spark, sf_dir, 60)


@_register
def reaction_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reaction(spark, sf_dir, 60, bounds="half_open")


@_register
def reaction_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reaction(spark, sf_dir, 60, open_close("bid"))


@_register
def reaction_high_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks, releases = _ticks(spark, sf_dir), _releases(spark, sf_dir)
    return reaction.reaction_high_low(ticks, releases, 60)


@_register
def agg_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reaction(spark, sf_dir, 60, [point("open")])


@_register
def agg_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reaction(spark, sf_dir, 60, [point("close")])


@_register
def agg_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reaction(spark, sf_dir, 60, [point("high")])


@_register
def max_ask_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.max_prices(_ticks(spark, sf_dir), _releases(spark, sf_dir), 5)


# Wide tables


@_register
def reaction_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.reaction_wide(_ticks(spark, sf_dir), _releases(spark, sf_dir), SHORT_FRAMES)


@_register
def reaction_wide_1_5_10_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.reaction_wide(_ticks(spark, sf_dir), _releases(spark, sf_dir), SCRIPT_FRAMES)


@_register
def reaction_wide_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks, releases = _ticks(spark, sf_dir), _releases(spark, sf_dir)
    stage = new_dir(spark, "segments")
    return reaction.reaction_wide_chained(ticks, releases, SHORT_FRAMES, stage)


def _reaction_edges(spark: SparkSession, sf_dir: str, bounds: str) -> DataFrame:
    """Quotes on the bounds of frames, at tied instants and tied prices."""
    ticks, releases = _edge_ticks(spark, sf_dir), _releases(spark, sf_dir)
    return reaction.reaction_wide(ticks, releases, [30, 60], open_close() + high_low(), bounds)


@_register
def reaction_edges_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reaction_edges(spark, sf_dir, "open")


@_register
def reaction_edges_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reaction_edges(spark, sf_dir, "half_open")


@_register
def reaction_from_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames read off stored chunks of sorted quotes, which are small here."""
    ticks, path = _ticks(spark, sf_dir), new_dir(spark, "chunks")
    calendar = frame_calendar(_releases(spark, sf_dir), SUMMARY_FRAMES)
    made = chunks.tick_chunks(ticks, calendar, chunk_rows=4, rows_per_split=8)
    made.write.parquet(path)
    stored = spark.read.schema(made.schema).parquet(path)
    return chunks.points_from_chunks(stored, calendar, SUMMARY_FRAMES, open_close())


@_register
def reaction_two_releases_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks, releases = _ticks(spark, sf_dir), _two_releases(spark, sf_dir)
    return reaction.reaction_wide(ticks, releases, SUMMARY_FRAMES)


@_register
def reaction_dense_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release every half hour, so that frames of an hour overlap."""
    raw = from_events.with_dense_releases(_raw_releases(spark, sf_dir))
    releases = _stored_releases(spark, raw)
    return reaction.reaction_wide(_ticks(spark, sf_dir), releases, SUMMARY_FRAMES)


@_register
def reaction_large_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar beyond the broadcast bound: its bitmaps meet the quotes, its releases the bars."""
    raw = from_events.with_dense_releases(_raw_releases(spark, sf_dir))
    ticks, releases = _ticks(spark, sf_dir), _stored_releases(spark, raw)
    calendar = frame_calendar(releases, SUMMARY_FRAMES, RELEASE_FACTS, max_broadcast_bytes=64 * 1024)
    segments = ops.segment_points(ticks, calendar, open_close(), group=ops.WIDE_GROUP)
    wide = ops.merge_segments(segments, SUMMARY_FRAMES, open_close(), ops.WIDE_GROUP)
    return ops.with_labels(wide)


@_register
def reaction_day_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes at rest by pair and day, sorted by time: only days and hours of frames are read."""
    path = new_dir(spark, "ticks")
    sinks.write_ticks(clean.clean_ticks(_raw_ticks(spark, sf_dir)), path)
    ticks, known = tables.read_ticks(spark, path), tables.quoted_days(spark, path)
    return reaction.reaction_wide(ticks, _releases(spark, sf_dir), SUMMARY_FRAMES, quoted_days=known)


@_register
def price_summary_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks, releases = _ticks(spark, sf_dir), _releases(spark, sf_dir)
    return reaction.price_summary_wide(ticks, releases, SUMMARY_FRAMES)


# Groups


@_register
def release_facts_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.release_facts(_ticks(spark, sf_dir), _releases(spark, sf_dir))


@_register
def ticks_per_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ticks_per_release(_ticks(spark, sf_dir), _releases(spark, sf_dir))


@_register
def release_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.release_group_count(_ticks(spark, sf_dir), _releases(spark, sf_dir))


# Gaps


@_register
def gap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_gap_lines(spark, sf_dir)
    return gaps.parse_gaps(files.read_gap_lines(spark, path))


@_register
def gap_parse_end_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = from_events.gap_lines_of(from_events.events(spark, sf_dir))
    return gaps.parse_gaps(lines, end_day=True)


@_register
def gap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_gap_lines(spark, sf_dir)
    return load.load_gaps(
        spark, {pair: f"{path}/curr_pair={pair}" for pair in from_events.PAIRS}
    )


# Incremental load


def _arriving(spark: SparkSession, sf_dir: str, part: str = "true") -> DataFrame:
    """A stream over a directory into which quotes have been delivered."""
    path = new_dir(spark, "inbox")
    ticks = _ticks(spark, sf_dir).where(part)
    ticks.write.parquet(path)
    return spark.readStream.schema(ticks.schema).parquet(path)


def _load(spark: SparkSession, arriving: DataFrame, releases: DataFrame, segments: str) -> None:
    checkpoint = new_dir(spark, "stream_checkpoint")
    incremental.load_increment(
        arriving, releases, SUMMARY_FRAMES, open_close(), segments, checkpoint
    )


def _increments(spark: SparkSession, segments: str) -> DataFrame:
    return incremental.read_increments(spark, segments, SUMMARY_FRAMES, open_close())


@_register
def incremental_reaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = new_dir(spark, "segments")
    _load(spark, _arriving(spark, sf_dir), _releases(spark, sf_dir), segments)
    return _increments(spark, segments)


# How the quotes are dealt to feeds.
_FEEDS = ["minute(ts) % 2 = 0", "minute(ts) % 2 = 1"]


@_register
def incremental_two_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds with checkpoints of their own fill one store."""
    segments, releases = new_dir(spark, "segments"), _releases(spark, sf_dir)
    for part in _FEEDS:
        _load(spark, _arriving(spark, sf_dir, part), releases, segments)
    return _increments(spark, segments)


@_register
def incremental_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compaction between two loads, and another at the end."""
    segments, releases = new_dir(spark, "segments"), _releases(spark, sf_dir)
    for part in _FEEDS:
        _load(spark, _arriving(spark, sf_dir, part), releases, segments)
        incremental.compact(spark, segments, SUMMARY_FRAMES, open_close())
    return _increments(spark, segments)


@_register
def incremental_late_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second release of each day becomes known after the load."""
    segments, path = new_dir(spark, "segments"), new_dir(spark, "ticks")
    _load(spark, _arriving(spark, sf_dir), _releases(spark, sf_dir), segments)
    _ticks(spark, sf_dir).drop("trade_dt").write.partitionBy("curr_pair", "day").parquet(path)
    rest = spark.read.schema(_ticks(spark, sf_dir).drop("trade_dt").schema).parquet(path)
    incremental.change_calendar(
        rest, _two_releases(spark, sf_dir), SUMMARY_FRAMES, open_close(), segments
    )
    return _increments(spark, segments)


@_register
def incremental_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table from increments: facts are joined when it is read."""
    segments, releases = new_dir(spark, "segments"), _releases(spark, sf_dir)
    _load(spark, _arriving(spark, sf_dir), releases, segments)
    wide = incremental.read_increments_wide(
        spark, releases, segments, SUMMARY_FRAMES, open_close()
    )
    return ops.with_labels(wide)


@_register
def closed_frame_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as the stream emits them; those that the last quote does not close are still open."""
    frames = incremental.closed_frames(
        _arriving(spark, sf_dir), _releases(spark, sf_dir), SUMMARY_FRAMES, open_close()
    )
    out = new_dir(spark, "closed_frames")
    query = (
        frames.writeStream.outputMode("append")
        .option("path", out)
        .option("checkpointLocation", new_dir(spark, "stream_checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(frames.schema).parquet(out)
