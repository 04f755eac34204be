"""Raw lines told apart: rows that become typed, and rejected lines with the reason.

Every line that is read comes out once: typed, with `reason` NULL, or rejected. A bad line
ends no load. Missing values, as the feeds have them, are no reason; values that are there but are not what
their column holds are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.functions import text
from ticklens.operators.gaps import gap_columns
from ticklens.schemas import PRICE, RAW_RELEASES, RELEASES, TICKS
from ticklens.sources.files import NULL_TEXT, RELEASE_DELIMITER, TICK_DELIMITER

#: What is known of a line: the feed's pair, the file it is in, and the line itself.
ORIGIN = ["curr_pair", "file", "line"]


def _first_reason(*cases: tuple[Column, str]) -> Column:
    """The name of the first condition that holds."""
    found = F.lit(None).cast("string")
    for condition, name in reversed(cases):
        found = F.when(condition, name).otherwise(found)
    return found


def _given(field: Column) -> Column:
    return F.coalesce(F.trim(field) != "", F.lit(False))


def checked_ticks(lines: DataFrame) -> DataFrame:
    """(curr_pair, file, line) -> the columns of TICKS, file, line, reason."""
    fields = F.split("line", TICK_DELIMITER, -1)
    raw = lines.withColumn("fields", fields).select(
        *ORIGIN,
        F.size("fields").alias("n"),
        *(F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(("trade_dt", "b", "a", "v"))),
    )
    typed = raw.withColumns(
        {
            **text.tick_parts(F.col("trade_dt")),
            "ts": text.tick_timestamp(F.col("trade_dt")),
            "bid": F.col("b").try_cast(PRICE),
            "ask": F.col("a").try_cast(PRICE),
        }
    )
    reason = _first_reason(
        (F.col("n") != 4, "fields"),
        (F.col("ts").isNull() | ~F.col("trade_dt").rlike(text.TICK_TIME), "time"),
        (F.col("bid").isNull() & _given(F.col("b")), "bid"),
        (F.col("ask").isNull() & _given(F.col("a")), "ask"),
        (F.col("v").try_cast("tinyint").isNull() & _given(F.col("v")), "vol"),
    )
    return typed.withColumn("reason", reason).select(*TICKS.names, "file", "line", "reason")


def checked_releases(lines: DataFrame) -> DataFrame:
    """(file, line) -> the columns of RELEASES, file, line, reason. Header lines are neither."""
    fields = F.split("line", rf"\{RELEASE_DELIMITER}", -1)
    raw = lines.withColumn("fields", fields).select(
        "file",
        "line",
        F.size("fields").alias("n"),
        *(
            F.nullif(F.get("fields", F.lit(i)), F.lit(NULL_TEXT)).alias(name)
            for i, name in enumerate(RAW_RELEASES.names)
        ),
    )
    raw = raw.where(~F.coalesce(F.col("release_time") == text.HEADER_TIME, F.lit(False)))
    figures = ("actual", "forecast", "previous")
    typed = raw.withColumns(
        {
            "trading_day": text.release_day(F.col("release_date")),
            "trading_hour": text.int_part(F.col("release_time"), 1, 2),
            "trading_min": text.int_part(F.col("release_time"), 4, 2),
            **{f"{name}_n": text.figure(F.col(name)) for name in figures},
        }
    )
    reason = _first_reason(
        (F.col("n") != len(RAW_RELEASES), "fields"),
        (F.col("trading_hour").isNull() | F.col("trading_min").isNull(), "time"),
        *((F.col(f"{name}_n").isNull() & _given(F.col(name)), name) for name in figures),
    )
    return typed.withColumn("reason", reason).select(
        *(F.col(f"{c}_n").alias(c) if c in figures else F.col(c) for c in RELEASES.names), "file", "line", "reason"
    )


def checked_gaps(lines: DataFrame, end_day: bool = False) -> DataFrame:
    """(curr_pair, file, line) -> the columns of a gap, file, line, reason."""
    columns, seconds = gap_columns(F.col("line"), end_day)
    reason = _first_reason(
        (~F.coalesce(F.col("line").rlike(text.WHOLE_GAP_LINE), F.lit(False)), "no gap report"),
        (seconds == 0, "no gap"),
        (seconds.try_cast("int").isNull(), "gap too long"),
    )
    return lines.select("curr_pair", *columns, "file", "line", reason.alias("reason"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("file", "line", "reason")


def rejected(checked: DataFrame, feed: str) -> DataFrame:
    """The rejected lines in the columns of the reject table."""
    pair = F.col("curr_pair") if "curr_pair" in checked.columns else F.lit(None).cast("string")
    bad = checked.where(F.col("reason").isNotNull())
    return bad.select(F.lit(feed).alias("feed"), pair.alias("curr_pair"), "file", "line", "reason")
