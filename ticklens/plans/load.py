"""Load the raw feeds into typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticklens.operators.checked import (
    accepted,
    checked_gaps,
    checked_releases,
    checked_ticks,
    rejected,
)
from ticklens.operators.clean import clean_releases, clean_ticks
from ticklens.operators.gaps import parse_gaps, union_gaps
from ticklens.sinks.tables import write_gaps, write_rejects, write_releases, write_ticks
from ticklens.sources.files import (
    read_gap_lines_of,
    read_lines,
    read_raw_releases,
    read_raw_ticks,
    read_raw_ticks_from,
)


def load_ticks(
    spark: SparkSession,
    source: str | dict[str, str],
    target: str,
    partition_by: tuple[str, ...] = ("curr_pair", "day"),
    rebalance: bool = True,
    rejects: str | None = None,
) -> None:
    """Load quotes from `curr_pair=` directories, or from a directory per named pair.

    With a table for `rejects`, lines that are no quote go there, with their file and the reason.
    """
    if rejects:
        checked = checked_ticks(_lines(spark, source))
        write_ticks(accepted(checked), target, partition_by, rebalance)
        write_rejects(rejected(checked, "ticks"), rejects)
        return
    raw = (
        read_raw_ticks_from(spark, source)
        if isinstance(source, dict)
        else read_raw_ticks(spark, source)
    )
    write_ticks(clean_ticks(raw), target, partition_by, rebalance)


def _lines(spark: SparkSession, source: str | dict[str, str]) -> DataFrame:
    """Lines of `curr_pair=` directories, or of a directory per named pair."""
    if not isinstance(source, dict):
        return read_lines(spark, source)
    return union_gaps([read_lines(spark, path, pair) for pair, path in source.items()])


def load_releases(
    spark: SparkSession, source: str, target: str, rejects: str | None = None
) -> None:
    """Overwrite the release table; with a table for `rejects`, bad lines go there."""
    if rejects:
        checked = checked_releases(read_lines(spark, source).drop("curr_pair"))
        write_releases(accepted(checked), target)
        write_rejects(rejected(checked, "releases"), rejects)
        return
    write_releases(clean_releases(read_raw_releases(spark, source)), target)


def load_gap_table(
    spark: SparkSession, source: str | dict[str, str], target: str, rejects: str
) -> None:
    """Overwrite the pairs that the reports hold in the table of gaps; other lines go to `rejects`."""
    checked = checked_gaps(_lines(spark, source))
    write_gaps(accepted(checked), target)
    write_rejects(rejected(checked, "gaps"), rejects)


def load_gaps(spark: SparkSession, directories: dict[str, str]) -> DataFrame:
    """The gaps of all pairs, one report directory each."""
    return union_gaps(
        [parse_gaps(read_gap_lines_of(spark, path, pair)) for pair, path in directories.items()]
    )
