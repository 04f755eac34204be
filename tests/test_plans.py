"""The physical plans are the intended ones."""

import re

import cases
import pytest

from ticklens.functions.points import open_close
from ticklens.operators import join
from ticklens.operators.calendar import frame_calendar
from ticklens.operators.reaction import segment_points
from ticklens.plans import reaction
from ticklens.registered import queries
from ticklens.sinks import tables as sinks
from ticklens.sources import tables

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> list[str]:
    return re.findall(r"FileScan parquet.*", plan(df))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Quotes by pair and day, and releases, at rest."""
    root = tmp_path_factory.mktemp("stored")
    sinks.write_ticks(cases.ticks(spark), f"{root}/ticks", ("curr_pair", "day"))
    sinks.write_releases(cases.releases(spark), f"{root}/releases")
    return tables.read_ticks(spark, f"{root}/ticks"), tables.read_releases(spark, f"{root}/releases")


def test_quotes_are_read_once_and_hash_aggregated(stored):
    text = plan(segment_points(stored[0], frame_calendar(stored[1], [1, 5, 15, 60]), open_close()))
    assert len(re.findall(r"FileScan parquet \[ts", text)) == 1
    # Below the first exchange: the scan, the bitmap of touched minutes, the partial aggregation.
    below = text[text.index("Exchange hashpartitioning(curr_pair") :].split("BroadcastExchange")[0]
    below = below[below.rindex("Exchange hashpartitioning(curr_pair") :]
    assert below.index("HashAggregate") < below.index("BroadcastHashJoin [day") < below.index("FileScan")
    assert "SortAggregate" not in below and "getbit" in below
    assert "SortMergeJoin" not in text and "NestedLoop" not in text


def test_number_of_frames_and_releases_adds_no_exchange(spark, stored):
    few = plan(reaction.reaction_wide(*stored, [1]))
    many = plan(reaction.reaction_wide(*stored, range(1, 21)))
    assert few.count("Exchange") == many.count("Exchange")
    assert few.count("FileScan") == many.count("FileScan")
    assert few.count("Exchange hashpartitioning(curr_pair") == 2


@pytest.fixture
def no_automatic_broadcast(spark):
    """What is broadcast then is what the library asks for."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_large_calendars_do_not_shuffle_quotes(stored, no_automatic_broadcast):
    """Quotes meet one bitmap per day; only bars are joined with the releases."""
    calendar = frame_calendar(stored[1], [1, 5], max_broadcast_bytes=2_000)
    text = plan(segment_points(stored[0], calendar, open_close()))
    assert "SortMergeJoin [day" in text
    below = text[text.rindex("Exchange hashpartitioning(curr_pair") :]
    assert "BroadcastHashJoin [day" in below and "getbit" in below


def test_only_touched_minutes_are_shuffled_for_single_quotes(stored):
    calendar = frame_calendar(stored[1], [5], max_broadcast_bytes=2_000)
    text = plan(join.frame_quotes(stored[0], calendar))
    sorted_side = text[text.index("SortMergeJoin [day") :]
    assert sorted_side.index("Exchange hashpartitioning(day") < sorted_side.index("getbit")
    assert sorted_side.index("getbit") < sorted_side.index("FileScan")


def test_known_days_push_hours_into_the_scan(spark, stored):
    """Files sorted by time are skipped by the hours of the frames; other quotes do not reach the aggregation."""
    known = stored[0].select("curr_pair", "day").distinct()
    text = plan(reaction.reaction_wide(*stored, [1, 5], quoted_days=known))
    quotes = [scan for scan in re.findall(r"FileScan parquet.*", text) if "ask" in scan]
    assert len(quotes) == 1 and re.search(r"PushedFilters: \[[^\]]*In\(hour", quotes[0])
    assert "dynamicpruning" in quotes[0]
    others = [scan for scan in re.findall(r"FileScan parquet \[curr_pair.*", text)]
    assert others and all("ReadSchema: struct<>" in scan for scan in others)


def test_only_needed_columns_are_read(stored):
    ticks = scans(reaction.reaction_wide(*stored, [1, 5]))[0]
    schema = re.search(r"ReadSchema: struct<([^>]*)>", ticks).group(1)
    assert schema == "ts:timestamp_ntz,ask:decimal(12,6)"


def test_days_without_a_release_are_not_read(stored):
    scan = scans(reaction.reaction_wide(*stored, [1, 5]))[0]
    assert "dynamicpruning" in scan
    assert ">=" not in scan


def test_a_pair_filter_prunes_partitions(stored):
    text = scans(stored[0].where("curr_pair = 'EURUSD'"))[0]
    assert re.search(r"PartitionFilters: \[[^\]]*curr_pair", text)


def test_a_large_calendar_is_not_broadcast(stored):
    text = plan(join.join_releases(*stored, max_broadcast_bytes=0))
    assert not re.search(r"BroadcastHashJoin \[day#\d+\], \[trading_day", text)
    assert re.search(r"SortMergeJoin \[day#\d+, split#\d+L\], \[trading_day#\d+, release_split", text)


def test_no_python_on_the_way(spark):
    for name in ("reaction_wide", "reaction_day_layout", "price_summary_wide", "tick_parse", "gap_parse"):
        text = plan(queries.all_queries()[name](spark, SF_DIR))
        assert "Python" not in text and "Pandas" not in text
        assert "CartesianProduct" not in text and "NestedLoop" not in text


