"""Quotes gathered into sorted chunks of bounded size, for consumers that want the quotes of a frame themselves.

A chunk holds quotes of one pair, day and minute as one array in order of time. A minute that holds more quotes
than a chunk may is cut into several, so no row grows with the data. Chunks are made once; any
list of frames within the calendar they were made for is read off them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklens.functions.frames import checked_frames, minute_band, minute_number
from ticklens.functions.points import PricePoint
from ticklens.operators.calendar import WHOLE_DAY, FrameCalendar
from ticklens.operators.join import ROWS_PER_SPLIT, hot_keys
from ticklens.operators.reaction import merge_segments
from ticklens.schemas import GROUP

#: Quotes of a chunk; some 200 KB.
CHUNK_ROWS = 4096
_KEYS = ["curr_pair", "day", "minute"]


def tick_chunks(
    ticks: DataFrame,
    calendar: FrameCalendar,
    prices: tuple[str, ...] = ("ask", "bid"),
    chunk_rows: int = CHUNK_ROWS,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """(curr_pair, day, minute, split, part, n, quotes) of the minutes that frames touch.

    Minutes that hold more than `rows_per_split` quotes are dealt over several tasks first. Every pair and day also has an
    empty chunk with minute NULL: it was quoted.
    """
    near = calendar.near_quotes(ticks.select("curr_pair", "day", "ts", *prices))
    quotes = near.where("near").select(
        "curr_pair", "day", minute_number(F.col("ts")).alias("minute"), "ts", *prices
    )
    hot = hot_keys(quotes, _KEYS, rows_per_split, calendar.max_broadcast_bytes)
    same = [F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in _KEYS]
    named = hot.withColumnsRenamed({k: f"hot_{k}" for k in _KEYS})
    place = F.xxhash64(F.spark_partition_id(), "ts", *prices)
    dealt = quotes.join(F.broadcast(named), same, "left").withColumn(
        "split", F.pmod(place, F.coalesce("splits", F.lit(1)))
    )
    in_order = Window.partitionBy(*_KEYS, "split").orderBy("ts", *prices)
    part = F.floor((F.row_number().over(in_order) - 1) / chunk_rows)
    quote = F.struct("ts", *prices)
    chunks = (
        dealt.withColumn("part", part)
        .groupBy(*_KEYS, "split", "part")
        .agg(F.count("*").alias("n"), F.array_sort(F.collect_list(quote)).alias("quotes"))
    )
    quoted = near.groupBy("curr_pair", "day").agg(F.lit(0).cast("bigint").alias("n"))
    empty = F.array().cast(chunks.schema["quotes"].dataType)
    return chunks.unionByName(quoted.withColumn("quotes", empty), allowMissingColumns=True)


def chunk_quotes(
    chunks: DataFrame, calendar: FrameCalendar, bounds: str = "open"
) -> DataFrame:
    """Chunks with the releases whose longest frame they touch; `quotes` are those inside.

    The empty chunk of a pair and day meets all releases of the day.
    """
    rows = calendar.broadcast_if_small(calendar.bands(whole_day=True), 3 * calendar.rows)
    whole = F.lit(WHOLE_DAY).cast("bigint")
    band = F.coalesce(minute_band(F.col("minute"), calendar.longest), whole)
    met = (F.col("day") == F.col("trading_day")) & (F.col("band") == F.col("release_band"))
    joined = chunks.withColumn("band", band).join(rows, met)
    end = F.col(f"frame_end_{calendar.longest}")

    def inside(quote):
        before = quote["ts"] < end if bounds == "open" else quote["ts"] <= end
        return (quote["ts"] > F.col("release_ts")) & before

    kept = joined.withColumn("quotes", F.filter("quotes", inside))
    return kept.where((F.size("quotes") > 0) | (F.col("band") == WHOLE_DAY)).drop("band", "release_band")


def points_from_chunks(
    chunks: DataFrame,
    calendar: FrameCalendar,
    frames: Iterable[int],
    points: list[PricePoint],
    bounds: str = "open",
    group: list[str] = GROUP,
    suffix: bool = True,
) -> DataFrame:
    """The price points of frames, read off the sorted quotes of the chunks."""
    minutes = checked_frames(frames)
    if not set(minutes) <= set(calendar.frames):
        raise ValueError(f"the calendar was made for frames {calendar.frames}")
    held = chunk_quotes(chunks, calendar, bounds)
    before = "<" if bounds == "open" else "<="
    shortest = " ".join(f"WHEN q.ts {before} frame_end_{n} THEN {n}" for n in minutes)
    # The quotes of a chunk are dealt to the shortest frames that hold them.
    parts = held.withColumn(
        "of_frame",
        F.expr(
            f"transform(array({', '.join(map(str, minutes))}), n -> "
            f"struct(n AS segment, filter(quotes, q -> CASE {shortest} END = n) AS quotes))"
        ),
    )
    parts = parts.withColumn("own", F.explode("of_frame")).where(
        "size(own.quotes) > 0 OR minute IS NULL"
    )
    partials = {}
    for p in points:
        time_first = p.kind in ("open", "close")
        shape = ["q.ts AS ts", f"q.{p.price} AS price"][:: 1 if time_first else -1]
        usable = f"filter(own.quotes, q -> q.{p.price} IS NOT NULL)"
        pick = "array_max" if p.kind in ("close", "high") else "array_min"
        partials[p.partial] = F.expr(f"{pick}(transform({usable}, q -> struct({', '.join(shape)})))")
    found = parts.select(
        *group, F.when(F.size("own.quotes") > 0, F.col("own.segment")).alias("segment"),
        *(c.alias(f"best_{name}") for name, c in partials.items()),
    )
    flat = found.select(
        *group,
        "segment",
        *(F.col(f"best_{n}.price").alias(n) for n in partials),
        *(F.col(f"best_{n}.ts").alias(f"{n}_ts") for n in partials),
    )
    return merge_segments(flat, minutes, points, group, suffix)
