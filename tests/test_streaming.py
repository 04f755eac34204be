"""Incremental load equals the batch result, whatever arrives when."""

from datetime import timedelta
from pathlib import Path

import cases
import pytest
from pyspark.sql import functions as F

from ticklens.functions.points import high_low, open_close
from ticklens.operators.reaction import WIDE_GROUP, frame_points, merge_segments
from ticklens.sinks import tables as sinks
from ticklens.sources import tables
from ticklens.streaming import incremental
from ticklens.streaming.store import SegmentStore

FRAMES = [1, 5, 60]
POINTS = open_close() + high_low()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream over a directory, and a function that puts quotes into it."""
    inbox = str(tmp_path / "inbox")
    ticks = cases.ticks(spark)

    def deliver(condition):
        ticks.where(condition).coalesce(1).write.mode("append").parquet(inbox)

    def stream():
        return spark.readStream.schema(ticks.schema).parquet(inbox)

    return deliver, stream


def batch(spark, condition="true"):
    return frame_points(cases.ticks(spark).where(condition), cases.releases(spark), FRAMES, POINTS)


def test_restart_with_a_second_file(spark, tmp_path, arriving):
    deliver, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def load():
        incremental.load_increment(
            stream(), cases.releases(spark), FRAMES, POINTS, out, checkpoint
        )
        return rows_of(incremental.read_increments(spark, out, FRAMES, POINTS))

    later = "sec >= 45"  # the second file holds earlier days again
    deliver(f"not ({later})")
    assert load() == rows_of(batch(spark, f"not ({later})"))
    deliver(later)
    assert load() == rows_of(batch(spark))
    assert load() == rows_of(batch(spark))  # nothing new


def test_a_batch_may_run_twice(spark, tmp_path, arriving):
    deliver, stream = arriving
    deliver("true")
    out = str(tmp_path / "out")
    for attempt in ("a", "b"):  # another checkpoint repeats batch 0
        incremental.load_increment(
            stream(), cases.releases(spark), FRAMES, POINTS, out, str(tmp_path / attempt)
        )
    assert rows_of(incremental.read_increments(spark, out, FRAMES, POINTS)) == rows_of(batch(spark))


def test_other_frames_are_not_mixed_in(spark, tmp_path, arriving):
    deliver, stream = arriving
    deliver("true")
    out, releases = str(tmp_path / "out"), cases.releases(spark)
    incremental.load_increment(stream(), releases, FRAMES, POINTS, out, str(tmp_path / "a"))
    nothing = incremental.read_increments(spark, out, [15], POINTS)
    assert nothing.collect() == []
    assert nothing.dtypes == frame_points(cases.ticks(spark), releases, [15], POINTS).dtypes
    assert incremental.read_increments(spark, out, FRAMES, POINTS, "half_open").collect() == []
    incremental.load_increment(
        stream(), releases, FRAMES, POINTS, out, str(tmp_path / "b"), "half_open"
    )
    got = incremental.read_increments(spark, out, FRAMES, POINTS, "half_open")
    want = frame_points(cases.ticks(spark), releases, FRAMES, POINTS, "half_open")
    assert rows_of(got) == rows_of(want)


def test_stateful_stream_in_complete_mode(spark, tmp_path, arriving):
    deliver, stream = arriving
    deliver("true")
    segments = incremental.segment_stream(stream(), cases.releases(spark), FRAMES, POINTS)
    name = "segments_" + tmp_path.name.replace("-", "_")
    query = (
        segments.writeStream.format("memory")
        .queryName(name)
        .outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert rows_of(merge_segments(spark.table(name), FRAMES, POINTS)) == rows_of(batch(spark))


def test_append_mode_emits_finished_days(spark, tmp_path, arriving):
    deliver, stream = arriving
    deliver("true")
    segments = incremental.segment_stream(
        stream(), cases.releases(spark), FRAMES, POINTS, watermark="10 minutes"
    )
    out = str(tmp_path / "out")
    query = (
        segments.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    merged = merge_segments(spark.read.parquet(out), FRAMES, POINTS)
    # The last day is still open.
    assert rows_of(merged) == rows_of(batch(spark).where("day < '20080404'"))


def load(spark, stream, out, checkpoint, releases=None):
    releases = cases.releases(spark) if releases is None else releases
    incremental.load_increment(stream(), releases, FRAMES, POINTS, out, checkpoint)


def read(spark, out):
    return rows_of(incremental.read_increments(spark, out, FRAMES, POINTS))


def data_files(out):
    return sorted(p for p in Path(out).rglob("data/*/part-*.parquet"))


def test_compaction_keeps_the_rows_and_drops_files(spark, tmp_path, arriving):
    deliver, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for second in ("sec < 20", "sec >= 20 and sec < 50", "sec >= 50"):
        deliver(second)
        load(spark, stream, out, checkpoint)
    want, before = rows_of(batch(spark)), len(data_files(out))
    assert read(spark, out) == want
    planned = incremental.read_increments(spark, out, FRAMES, POINTS)
    incremental.compact(spark, out, FRAMES, POINTS)
    assert read(spark, out) == want == rows_of(planned)  # a reader from before can finish
    assert incremental.compact(spark, out, FRAMES, POINTS) == 3
    assert read(spark, out) == want and len(data_files(out)) < before
    deliver("true")  # and the load goes on
    load(spark, stream, out, checkpoint)
    assert read(spark, out) == want


@pytest.mark.parametrize("step", ["write", "commit", "vacuum"])
def test_a_crash_in_a_compaction_loses_nothing(spark, tmp_path, arriving, monkeypatch, step):
    deliver, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for part in ("sec < 45", "sec >= 45"):
        deliver(part)
        load(spark, stream, out, checkpoint)
    real = getattr(SegmentStore, step)

    def crash(self, *args, **kwargs):
        if step == "write":  # the rows are there, but their name is lost
            real(self, *args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(SegmentStore, step, crash)
    with pytest.raises(RuntimeError):
        incremental.compact(spark, out, FRAMES, POINTS)
    monkeypatch.undo()
    assert read(spark, out) == rows_of(batch(spark))
    incremental.compact(spark, out, FRAMES, POINTS)
    incremental.compact(spark, out, FRAMES, POINTS)
    # What counts, what it replaced, and the calendar.
    assert read(spark, out) == rows_of(batch(spark)) and len({f.parent for f in data_files(out)}) == 3


def test_a_generation_left_half_written_is_taken_over(spark, tmp_path, arriving):
    deliver, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    deliver("sec < 45")
    load(spark, stream, out, checkpoint)
    store = incremental.segment_store(spark, out, FRAMES, POINTS)
    Path(f"{store.path}/log/generation={store.state().generation + 1}/_temporary").mkdir(parents=True)
    deliver("sec >= 45")
    load(spark, stream, out, checkpoint)
    assert read(spark, out) == rows_of(batch(spark))


def test_additions_during_a_compaction_stay(spark, tmp_path, arriving):
    deliver, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    deliver("sec < 45")
    load(spark, stream, out, checkpoint)
    store = incremental.segment_store(spark, out, FRAMES, POINTS)
    state, rows = store.state(), store.read()
    deliver("sec >= 45")
    load(spark, stream, out, checkpoint)
    store.replace(state, rows)
    assert read(spark, out) == rows_of(batch(spark))


def test_late_releases_read_only_their_days(spark, tmp_path, arriving):
    deliver, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    rest = tmp_path / "rest"
    sinks.write_ticks(cases.ticks(spark), str(rest), ("curr_pair", "day"))
    full = cases.releases(spark)
    late = F.col("trading_day") == "20080404"
    deliver("true")
    load(spark, stream, out, checkpoint, full.where(~late | F.col("trading_hour").isNull()))
    assert read(spark, out) == rows_of(batch(spark).where("day <> '20080404'"))
    for file in rest.glob("curr_pair=*/day=*/*.parquet"):
        if "20080404" not in str(file):
            file.write_bytes(b"not to be read")
    ticks = tables.read_ticks(spark, str(rest))
    incremental.change_calendar(ticks, full, FRAMES, POINTS, out)
    assert read(spark, out) == rows_of(batch(spark))
    with pytest.raises(ValueError):
        load(spark, stream, out, checkpoint, full.where(~late))
    load(spark, stream, out, checkpoint, full)
    # Releases that are gone, or have moved, take their rows along.
    incremental.change_calendar(ticks, full.where("trading_hour <> 10 OR NOT trading_day = '20080404'"), FRAMES, POINTS, out)
    want = rows_of(batch(spark).where("NOT (day = '20080404' AND trading_hour = 10)"))
    assert read(spark, out) == want
    incremental.compact(spark, out, FRAMES, POINTS)
    assert read(spark, out) == want


def test_wide_increments_have_the_facts_of_today(spark, tmp_path, arriving):
    deliver, stream = arriving
    out = str(tmp_path / "out")
    deliver("true")
    load(spark, stream, out, str(tmp_path / "checkpoint"))
    corrected = cases.releases(spark).withColumn("actual", F.col("actual") + 1)
    got = incremental.read_increments_wide(spark, corrected, out, FRAMES, POINTS)
    want = frame_points(cases.ticks(spark), corrected, FRAMES, POINTS, group=WIDE_GROUP)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


def frames_of(spark, condition="true", bounds="open"):
    """Every frame with a quote as a row, from the batch result."""
    wide = frame_points(cases.ticks(spark).where(condition), cases.releases(spark), FRAMES, POINTS, bounds)
    names = [n for p in POINTS for n in (p.price_name, p.ts_name)]
    rows = set()
    for row in wide.collect():
        for n in FRAMES:
            values = tuple(row[f"{name}_{n}"] for name in names)
            if any(v is not None for v in values):
                key = (row.curr_pair, row.day, row.trading_hour, row.trading_min, n)
                rows.add((*key, *values))
    return names, rows


@pytest.mark.parametrize("bounds", ["open", "half_open"])
def test_closed_frames_come_once_and_leave_the_state(spark, tmp_path, arriving, bounds):
    deliver, stream = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    names, want = frames_of(spark, bounds=bounds)

    def run():
        frames = incremental.closed_frames(stream(), cases.releases(spark), FRAMES, POINTS, timedelta(0), bounds)
        query = (
            frames.writeStream.outputMode("append")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        rows = spark.read.schema(frames.schema).parquet(out).select("curr_pair", "day", "trading_hour", "trading_min", "frame", *names)
        return [tuple(r) for r in rows.collect()], state[-1]

    # Up to 08:34:59.999 of the first day: only its frame of one minute is over.
    deliver("day = '20080104' and (hour < 8 or hour = 8 and min < 35)")
    rows, left = run()
    first = {r for r in want if r[1] == "20080104" and r[4] == 1}
    assert set(rows) == first and len(rows) == len(first) and left > 0
    # A quote of a day without a release closes what is open, and none is emitted again.
    deliver("day = '20080104' and (hour > 8 or min >= 35) or day = '20080201' or day = '20080308'")
    rows, left = run()
    closed = {r for r in want if r[1] < "20080308"} - {r for r in want if r[1] == "20080307"}
    assert set(rows) == closed and len(rows) == len(closed) and left == 0
    # Too late for its frame.
    deliver("day = '20080307'")
    assert set(run()[0]) == closed
