"""Random quotes full of ties against a plain loop, under any partitioning."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ticklens.functions.frames import in_frame
from ticklens.functions.points import high_low, max_and_close, open_close
from ticklens.operators import chunks, join
from ticklens.operators import reaction as ops
from ticklens.operators.calendar import MAX_BROADCAST_BYTES, frame_calendar
from ticklens.plans import reaction
from ticklens.schemas import RELEASES

FRAMES = [1, 3, 7, 60]
POINTS = open_close() + high_low() + open_close("bid")[1:]


def random_ticks(seed, rows=1500):
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        day = datetime(2024, 3, rng.choice([8, 8, 8, 9]))
        second = rng.choice([rng.randrange(30600, 30800), rng.randrange(86400)])
        ts = day + timedelta(seconds=second, microseconds=rng.choice([0, 0, 1, 999999]))
        price = Decimal(rng.choice([-5, 0, 1, 2, 3, 999999])) + Decimal(rng.randrange(3)) / 1000000
        ask = None if rng.random() < 0.05 else price
        out.append((rng.choice(["A", "B"]), day.strftime("%Y%m%d"), ts, price, ask))
    return out


RELEASE_ROWS = [
    ("20240308", 8, 30, 1, None, 3),
    ("20240308", 8, 31, 4, 5, 6),
    ("20240309", 23, 50, 7, 8, 9),
    ("20240310", 8, 30, 7, 8, 9),
    ("2024NA10", 8, 30, 7, 8, 9),
]


def frames(spark, seed):
    ticks = spark.createDataFrame(
        random_ticks(seed),
        "curr_pair string, day string, ts timestamp_ntz, bid decimal(12,6), ask decimal(12,6)",
    )
    rows = [("", "", a, f, p, d, h, m) for d, h, m, p, f, a in RELEASE_ROWS]
    return ticks, spark.createDataFrame(rows, RELEASES)


def brute(rows, bounds):
    """Group -> frame -> kind -> (price, ts)."""
    result = {}
    for pair in ("A", "B"):
        for day, hour, minute, *_ in RELEASE_ROWS:
            mine = [r for r in rows if r[0] == pair and r[1] == day]
            if not mine:
                continue
            t0 = datetime.strptime(day, "%Y%m%d") + timedelta(hours=hour, minutes=minute)
            for n in FRAMES:
                end = t0 + timedelta(minutes=n)
                inside = [
                    r for r in mine if r[2] > t0 and (r[2] < end or bounds != "open" and r[2] == end)
                ]
                asks = [(r[2], r[4]) for r in inside if r[4] is not None]
                bids = [(r[2], r[3]) for r in inside]
                swap = lambda pair: pair and (pair[1], pair[0])
                by_price = [(p, t) for t, p in asks]
                result[pair, day, hour, minute, n] = {
                    "open": swap(min(asks, default=None)),
                    "close": swap(max(asks, default=None)),
                    "high": max(by_price, default=None),
                    "low": min(by_price, default=None),
                    "close_bid": swap(max(bids, default=None)),
                    "high_bid": max([(p, t) for t, p in bids], default=None),
                }
    return result


def points_of(row, n, names):
    pairs = {kind: (row[f"{price}_{n}"], row[f"{ts}_{n}"]) for kind, price, ts in names}
    return {kind: None if pair == (None, None) else pair for kind, pair in pairs.items()}


OHLC = [(k, f"{k}_price", f"{k}_price_ts") for k in ("open", "close", "high", "low")]
SUMMARY = [
    ("high", "max_ask", "max_ask_dt"),
    ("close", "close_ask", "close_ask_dt"),
    ("high_bid", "max_bid", "max_bid_dt"),
    ("close_bid", "close_bid", "close_bid_dt"),
]


@pytest.mark.parametrize("bounds", ["open", "half_open"])
@pytest.mark.parametrize("seed,partitions", [(1, 1), (1, 17), (2, 5)])
def test_points(spark, seed, partitions, bounds):
    ticks, releases = frames(spark, seed)
    expected = brute(random_ticks(seed), bounds)
    for points, names in ((open_close() + high_low(), OHLC), (max_and_close(), SUMMARY)):
        result = ops.frame_points(ticks.repartition(partitions), releases, FRAMES, points, bounds)
        rows = result.collect()
        assert len(rows) * len(FRAMES) == len(expected)
        for row in rows:
            for n in FRAMES:
                want = expected[row.curr_pair, row.day, row.trading_hour, row.trading_min, n]
                got = points_of(row, n, names)
                assert got == {kind: want[kind] for kind in got}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_chained_equals_one_pass(spark, tmp_path):
    ticks, releases = frames(spark, 3)
    chained = reaction.reaction_wide_chained(ticks, releases, FRAMES, str(tmp_path / "stage"))
    assert rows_of(chained) == rows_of(reaction.reaction_wide(ticks, releases, FRAMES))


@pytest.mark.parametrize("rows_per_split", [1, 7, 10_000])
def test_calendar_beyond_the_broadcast_bound(spark, rows_per_split):
    """The shuffled join finds the same rows as the broadcast, however hot days are split."""
    ticks, releases = frames(spark, 4)
    ticks = ticks.repartition(13)
    small = join.join_releases(ticks, releases)
    large = join.join_releases(ticks, releases, max_broadcast_bytes=0, rows_per_split=rows_per_split)
    assert small.columns == large.columns
    assert rows_of(small) == rows_of(large)


def test_only_hot_keys_are_split(spark):
    ticks, _ = frames(spark, 4)
    n = {r["day"]: r["count"] for r in ticks.groupBy("day").count().collect()}
    hot = {r["day"]: r["splits"] for r in join.hot_keys(ticks, ["day"], 500, 1 << 20).collect()}
    assert hot == {day: -(-k // 500) for day, k in n.items() if k > 500} and len(hot) < len(n)
    # Where the list would not fit the bound, splits grow instead.
    assert join.hot_keys(ticks, ["day"], 1, 128).count() <= 1


@pytest.mark.parametrize("bounds", ["open", "half_open"])
@pytest.mark.parametrize("max_bytes", [0, 1000, MAX_BROADCAST_BYTES])
def test_calendars_of_any_size(spark, bounds, max_bytes):
    """Bars, and single quotes of frames, with and without bitmaps and broadcasts."""
    ticks, releases = frames(spark, 6)
    calendar = frame_calendar(releases, FRAMES, max_broadcast_bytes=max_bytes)
    segments = ops.segment_points(ticks, calendar, POINTS, bounds)
    want = ops.frame_points(ticks, releases, FRAMES, POINTS, bounds)
    assert rows_of(ops.merge_segments(segments, FRAMES, POINTS)) == rows_of(want)
    got = join.frame_quotes(ticks, calendar, bounds, rows_per_split=9)
    plain = ticks.join(calendar.releases, F.col("day") == F.col("trading_day"))
    plain = plain.where(in_frame(FRAMES[-1], bounds))
    assert got.columns == plain.columns and rows_of(got) == rows_of(plain)


def test_bad_times_keep_their_groups(spark):
    """Quotes without a time, or dated another day than theirs, and releases without a clock."""
    at = datetime(2024, 3, 8, 8, 30, 30)
    rows = [
        ("A", "20240308", None, Decimal(1), Decimal(1)),
        ("B", "20240308", at + timedelta(days=1), Decimal(1), Decimal(1)),
        ("C", "20240308", at, Decimal(1), Decimal(2)),
        (None, "20240308", at, Decimal(1), Decimal(3)),
        ("D", "20240310", at, Decimal(1), Decimal(1)),
    ]
    ticks = spark.createDataFrame(
        rows, "curr_pair string, day string, ts timestamp_ntz, bid decimal(12,6), ask decimal(12,6)"
    )
    times = [("20240308", 8, 30), ("20240308", None, 30), ("20240308", 25, 0), (None, 8, 30)]
    releases = spark.createDataFrame([("", "", 1, 1, 1, *t) for t in times], RELEASES)
    result = ops.frame_points(ticks, releases, [1], open_close())
    got = {(r.curr_pair, r.trading_hour): r.open_price_1 for r in result.collect()}
    assert got == {
        (pair, hour): {"C": Decimal(2), None: Decimal(3)}.get(pair) if hour == 8 else None
        for pair in ("A", "B", "C", None)
        for hour in (8, None, 25)
    }


@pytest.mark.parametrize("hour", [0, 8, 23])
def test_known_days_replace_the_other_quotes(spark, tmp_path, hour):
    """With the partitions of a table, only quotes in frames are read; the result is the same."""
    ticks, _ = frames(spark, 7)
    releases = spark.createDataFrame(
        [("", "", 1, 1, 1, day, hour, 59) for day in ("20240308", "20240309", "20240311")], RELEASES
    )
    stored = ticks.withColumn("hour", F.hour("ts"))
    known = stored.select("curr_pair", "day").distinct()
    got = reaction.reaction_wide(stored, releases, FRAMES, quoted_days=known)
    assert rows_of(got) == rows_of(reaction.reaction_wide(ticks, releases, FRAMES))


def test_invariants(spark):
    ticks, releases = frames(spark, 5)
    result = ops.frame_points(ticks, releases, FRAMES, open_close() + high_low())
    for row in result.collect():
        for n in FRAMES:
            if row[f"open_price_{n}"] is None:
                continue
            assert row[f"low_price_{n}"] <= row[f"open_price_{n}"] <= row[f"high_price_{n}"]
            assert row[f"low_price_{n}"] <= row[f"close_price_{n}"] <= row[f"high_price_{n}"]
            assert row[f"open_price_ts_{n}"] <= row[f"close_price_ts_{n}"]
        for shorter, longer in zip(FRAMES, FRAMES[1:]):
            if row[f"open_price_{shorter}"] is not None:
                assert row[f"open_price_{longer}"] == row[f"open_price_{shorter}"]
                assert row[f"high_price_{longer}"] >= row[f"high_price_{shorter}"]


@pytest.mark.parametrize("bounds", ["open", "half_open"])
@pytest.mark.parametrize("chunk_rows,rows_per_split", [(1, 1), (7, 50), (4096, 1 << 22)])
def test_chunks_hold_the_quotes_of_frames(spark, bounds, chunk_rows, rows_per_split):
    """Frames read off chunks equal those from the quotes, and no chunk outgrows its bound."""
    ticks, releases = frames(spark, 8)
    calendar = frame_calendar(releases, FRAMES)
    made = chunks.tick_chunks(ticks.repartition(7), calendar, ("ask", "bid"), chunk_rows, rows_per_split)
    sizes = [r.n for r in made.collect()]
    assert max(sizes) <= chunk_rows and sum(sizes) > 500
    for wanted in (FRAMES, [3]):
        got = chunks.points_from_chunks(made, calendar, wanted, POINTS, bounds)
        want = ops.frame_points(ticks, releases, wanted, POINTS, bounds)
        assert got.columns == want.columns and rows_of(got) == rows_of(want)
    with pytest.raises(ValueError):
        chunks.points_from_chunks(made, calendar, [2], POINTS)


def test_frames_are_checked(spark):
    ticks, releases = frames(spark, 1)
    for bad in ([], [0], [-1, 5]):
        with pytest.raises(ValueError):
            ops.frame_points(ticks, releases, bad, POINTS)
    with pytest.raises(ValueError):
        ops.frame_points(ticks, releases, [1], POINTS, bounds="closed")
