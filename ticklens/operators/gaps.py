"""Reports of gaps in the quote feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.functions.text import WHOLE_GAP_LINE

# Column, boundary it is cut from, position, length.
_PARTS = [
    ("day", "start", 1, 8),
    ("start_hour", "start", 9, 2),
    ("start_min", "start", 11, 2),
    ("start_sec", "start", 13, 2),
    ("end_hour", "end", 9, 2),
    ("end_min", "end", 11, 2),
    ("end_sec", "end", 13, 2),
]


def gap_columns(line: Column, end_day: bool = False) -> tuple[list[Column], Column]:
    """Gap length (NULL beyond int) and boundaries of a line, and the length as it is written."""
    seconds = F.nullif(F.regexp_extract(line, WHOLE_GAP_LINE, 1), F.lit("")).try_cast("decimal(38,0)")
    sides = {"start": F.regexp_extract(line, WHOLE_GAP_LINE, 2), "end": F.regexp_extract(line, WHOLE_GAP_LINE, 3)}
    parts = [F.substring(sides[side], pos, size).alias(name) for name, side, pos, size in _PARTS]
    if end_day:
        parts.append(F.substring(sides["end"], 1, 8).alias("end_day"))
    return [seconds.try_cast("int").alias("gap"), *parts], seconds


def parse_gaps(lines: DataFrame, line: str = "line", end_day: bool = False) -> DataFrame:
    """Gap length and boundaries of the lines that report a gap of at least one second.

    A line counts only if the whole of it matches. `end_day` adds the day the gap
    ends on. A gap that does not fit an int ends the load; `checked.checked_gaps` rejects its line instead.
    """
    columns, seconds = gap_columns(F.col(line), end_day)
    gap = seconds.cast("int").alias("gap")
    matched = lines.where(F.col(line).rlike(WHOLE_GAP_LINE)).where(seconds != 0)
    return matched.select("curr_pair", gap, *columns[1:])


def union_gaps(feeds: list[DataFrame]) -> DataFrame:
    """All feeds one after the other, duplicates included."""
    return reduce(DataFrame.unionByName, feeds)
