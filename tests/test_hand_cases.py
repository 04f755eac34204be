"""Hand-made cases at the edges of a frame, a day and a group."""

from datetime import datetime
from decimal import Decimal

import cases
import pytest

from ticklens.functions.points import high_low, open_close
from ticklens.operators import clean, gaps, join
from ticklens.operators import reaction as ops
from ticklens.plans import reaction


def at(text):
    return datetime.strptime(text, "%Y-%m-%d %H:%M:%S.%f")


POINTS = open_close() + high_low()

# day, hour, minute, pair, frame, bounds -> open, close, high, low
EXPECTED = [
    ("20080104", 8, 30, "EURUSD", 1, "open", "1.472 1.469 1.475 1.469"),
    ("20080104", 8, 30, "EURUSD", 1, "half_open", "1.472 1.474 1.475 1.469"),
    ("20080104", 8, 30, "EURUSD", 5, "open", "1.472 1.473 1.475 1.469"),
    ("20080104", 8, 30, "EURUSD", 5, "half_open", "1.472 1.480 1.480 1.469"),
    ("20080104", 8, 30, "GBPUSD", 5, "open", None),
    ("20080201", 8, 30, "EURUSD", 1, "open", "1.481 1.482 1.482 1.481"),
    ("20080307", 23, 58, "EURUSD", 5, "open", "1.500 1.500 1.500 1.500"),
    ("20080404", 8, 30, "EURUSD", 5, "open", "1.570 1.570 1.570 1.570"),
    ("20080404", 10, 0, "EURUSD", 5, "open", "1.580 1.580 1.580 1.580"),
]


@pytest.mark.parametrize("day,hour,minute,pair,n,bounds,prices", EXPECTED)
def test_prices_of_a_frame(spark, day, hour, minute, pair, n, bounds, prices):
    result = reaction.reaction(cases.ticks(spark), cases.releases(spark), n, POINTS, bounds)
    rows = result.where(
        (result.day == day)
        & (result.trading_hour == hour)
        & (result.trading_min == minute)
        & (result.curr_pair == pair)
    ).collect()
    assert len(rows) == 1
    got = [rows[0][f"{k}_price"] for k in ("open", "close", "high", "low")]
    assert got == ([Decimal(p) for p in prices.split()] if prices else [None] * 4)


@pytest.mark.parametrize(
    "n,bounds,times",
    [
        (1, "open", ["08:30:00.001", "08:30:50.000", "08:30:45.000", "08:30:50.000"]),
        (1, "half_open", ["08:30:00.001", "08:31:00.000", "08:30:45.000", "08:30:50.000"]),
        (5, "open", ["08:30:00.001", "08:34:59.999", "08:30:45.000", "08:30:50.000"]),
        (5, "half_open", ["08:30:00.001", "08:35:00.000", "08:35:00.000", "08:30:50.000"]),
    ],
)
def test_times_of_a_frame(spark, n, bounds, times):
    result = reaction.reaction(cases.ticks(spark), cases.releases(spark), n, POINTS, bounds)
    row = result.where("day = '20080104' and curr_pair = 'EURUSD'").first()
    got = [row[f"{k}_price_ts"] for k in ("open", "close", "high", "low")]
    assert got == [at(f"2008-01-04 {t}") for t in times]


def test_groups(spark):
    result = reaction.reaction(cases.ticks(spark), cases.releases(spark), 5)
    groups = {(r.curr_pair, r.day, r.trading_hour) for r in result.collect()}
    assert groups == {
        ("EURUSD", "20080104", 8),
        ("GBPUSD", "20080104", 8),
        ("EURUSD", "20080201", 8),
        ("EURUSD", "20080307", 23),
        ("EURUSD", "20080404", 8),
        ("EURUSD", "20080404", 10),
    }


def test_wide_table(spark):
    result = reaction.reaction_wide(cases.ticks(spark), cases.releases(spark), [5, 1])
    assert result.columns == [
        *("key0", "previous", "forecast", "actual", "curr_pair", "day", "time"),
        *("open_price_1", "open_price_ts_1", "close_price_1", "close_price_ts_1"),
        *("open_price_5", "open_price_ts_5", "close_price_5", "close_price_ts_5"),
    ]
    rows = {(r.key0, r.time): r for r in result.collect()}
    assert len(rows) == 6
    row = rows["EURUSD20080201", "830"]
    assert (row.previous, row.forecast, row.actual) == (18, None, -17)
    assert rows["EURUSD20080404", "100"].open_price_1 == Decimal("1.58")


def test_price_summary_schema(spark):
    result = reaction.price_summary_wide(cases.ticks(spark), cases.releases(spark), [1, 5])
    names = [
        f"{what}_{price}{dt}_{n}"
        for n in (1, 5)
        for price in ("ask", "bid")
        for what in ("max", "close")
        for dt in ("", "_dt")
    ]
    assert result.columns[7:] == names
    types = dict(result.dtypes)
    assert {types[n] for n in names if "_dt_" in n} == {"timestamp_ntz"}
    assert {types[n] for n in names if "_dt_" not in n} == {"decimal(12,6)"}


def test_max_prices(spark):
    rows = ops.max_prices(cases.ticks(spark), cases.releases(spark), 5).collect()
    best = {(r.curr_pair, r.day, r.trading_hour): r.max_ask for r in rows}
    assert best["EURUSD", "20080104", 8] == Decimal("1.48")
    assert best["GBPUSD", "20080104", 8] is None


def test_releases_are_cleaned(spark):
    rows = cases.releases(spark).collect()
    assert [r.trading_day for r in rows] == [
        *("20080104", "20080201", "20080307", "20080404", "20080404", "2008NA02"),
    ]
    assert (rows[1].actual, rows[1].forecast, rows[1].previous) == (-17, None, 18)
    assert (rows[2].trading_hour, rows[2].trading_min) == (23, 58)


def test_release_view_and_surprise(spark):
    history = clean.release_history(cases.releases(spark))
    assert history.first().asDict() == {
        "trading_day": "20080104",
        "trading_time": "8:30",
        "actual": 18,
        "forecast": 70,
        "previous": 115,
    }
    rows = clean.release_surprise(history).collect()
    assert (rows[0].diff_forecast, rows[0].diff_previous) == (-52, -97)
    assert (rows[1].diff_forecast, rows[1].diff_previous) == (None, -35)


def test_last_release_of_a_day(spark):
    rows = join.latest_release_per_day(cases.releases(spark)).where("trading_day = '20080404'")
    assert [(r.trading_hour, r.actual) for r in rows.collect()] == [(10, 3)]


def test_counts(spark):
    ticks, releases = cases.ticks(spark), cases.releases(spark)
    counts = {(r.curr_pair, r.day): r.n_ticks for r in ops.ticks_per_release(ticks, releases).collect()}
    assert counts == {
        ("EURUSD", "20080104"): 9,
        ("GBPUSD", "20080104"): 1,
        ("EURUSD", "20080201"): 2,
        ("EURUSD", "20080307"): 1,
        ("EURUSD", "20080404"): 2,
    }
    assert ops.release_group_count(ticks, releases).first().n_groups == 5


def test_gap_lines(spark):
    lines = spark.createDataFrame(
        [(line, "EURUSD") for line in cases.GAPS.splitlines()], "line string, curr_pair string"
    )
    rows = [tuple(r)[1:] for r in gaps.parse_gaps(lines).collect()]
    assert rows == [
        (61, "20080104", "08", "30", "00", "08", "31", "01"),
        (120, "20080104", "23", "59", "00", "00", "01", "00"),
    ]
    assert [r.end_day for r in gaps.parse_gaps(lines, end_day=True).collect()] == [
        *("20080104", "20080105"),
    ]
    assert gaps.union_gaps([gaps.parse_gaps(lines)] * 3).count() == 6
