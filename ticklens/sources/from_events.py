"""Quotes, releases and gap reports derived from the generic `events` table.

The test data has no foreign-exchange feed, so these adapters make one from every
row of `events`. They stand for the feeds only; nothing else depends on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklens.operators.neighbours import with_next
from ticklens.schemas import RAW_RELEASES

# Fixed values of the test feed.
PAIRS = ["EURUSD", "GBPUSD", "USDJPY"]
RELEASE_TIME = "08:30"
SECOND_RELEASE_TIME = "14:05"


def digits(ts: Column) -> Column:
    """`YYYYMMDDHHMMSS` and whatever fraction is there, free of time zones."""
    return F.translate(ts.cast("string"), "-: .", "")


def day_text(ts: Column) -> Column:
    return F.replace(ts.cast("date").cast("string"), F.lit("-"), F.lit(""))


def second_text(ts: Column) -> Column:
    return F.substring(digits(ts), 1, 14)


def tick_text(ts: Column) -> Column:
    """`YYYYMMDD HHMMSSmmm`."""
    padded = F.rpad(digits(ts), 17, "0")
    return F.concat(F.substring(padded, 1, 8), F.lit(" "), F.substring(padded, 9, 9))


def pair_of(user_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PAIRS)), (user_id % 3).cast("int") + 1)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ticks_of(source: DataFrame) -> DataFrame:
    """One quote per event; works on a stream as well."""
    bid = F.col("value").cast("decimal(12,6)")
    step = (F.col("event_id") % 10).cast("decimal(12,6)") * F.lit(0.0001).cast("decimal(5,4)")
    return source.select(
        day_text(F.col("ts")).alias("day"),
        "ts",
        tick_text(F.col("ts")).alias("trade_dt"),
        pair_of(F.col("user_id")).alias("curr_pair"),
        bid.alias("bid"),
        (bid + step).cast("decimal(12,6)").alias("ask"),
    )


def edge_ticks_of(source: DataFrame) -> DataFrame:
    """Every quote, and each once more at the half hour before it.

    Half hours are where frames start and end, so many quotes lie on the bounds of frames, at one instant, and at one
    price.
    """
    ticks = ticks_of(source)
    half = F.expr(
        "date_trunc('hour', ts) + make_dt_interval(0, 0, 30 * (minute(ts) DIV 30))"
    ).cast("timestamp_ntz")
    return ticks.unionByName(ticks.withColumn("ts", half))


def raw_ticks_of(source: DataFrame) -> DataFrame:
    """The quotes in the columns of the text feed."""
    return ticks_of(source).select(
        "trade_dt", "bid", "ask", F.lit(0).cast("tinyint").alias("vol"), "curr_pair"
    )


def bad_tick_lines_of(source: DataFrame) -> DataFrame:
    """A line that is no quote for every 97th event: too short, no time, no price, a price or volume too large."""
    kind = F.expr("event_id DIV 97 % 5")
    shown = source.where("event_id % 97 = 0").select(
        pair_of(F.col("user_id")).alias("curr_pair"), kind.alias("kind"), tick_text(F.col("ts")).alias("t")
    )
    ends = [",1.5", ",1,1,0", ",x,1,0", ",1,12345678.5,0", ",1,1,999"]
    line = F.concat(
        F.when(F.col("kind") == 1, F.lit("20241301 083000000")).otherwise(F.col("t")),
        F.element_at(F.array(*map(F.lit, ends)), (F.col("kind") + 1).cast("int")),
    )
    return shown.select("curr_pair", line.alias("line"))


def bad_gap_lines_of(source: DataFrame) -> DataFrame:
    """A line that reports no gap for every 97th event: another text, a gap too long, a gap of zero."""
    lines = [
        "some header",
        "Gap of 99999999999s found between 20240101000000 and 20240102000000.",
        "Gap of 0s found between 20240101000000 and 20240101000000.",
    ]
    at = F.expr("CAST(event_id DIV 97 % 3 AS INT) + 1")
    return source.where("event_id % 97 = 0").select(
        pair_of(F.col("user_id")).alias("curr_pair"),
        F.element_at(F.array(*map(F.lit, lines)), at).alias("line"),
    )


def raw_releases_of(source: DataFrame) -> DataFrame:
    """One release per day, its figures made from the counts of the day.

    The window runs over one row per calendar day, a few thousand for any span of
    data, after the events have been counted where they are read.
    """
    daily = source.groupBy(day_text(F.col("ts")).alias("d")).agg(
        F.min("ts").alias("m"),
        F.count("*").cast("int").alias("a"),
        (2 * F.count_if(F.col("user_id") % 2 == 0)).cast("int").alias("f"),
    )
    before = F.lag("a").over(Window.orderBy("d"))
    return daily.select(
        F.date_format("m", "MMM dd, yyyy").alias("release_date"),
        F.lit(RELEASE_TIME).alias("release_time"),
        F.concat("a", F.lit("K")).alias("actual"),
        F.concat("f", F.lit("K")).alias("forecast"),
        F.coalesce(F.concat(before, F.lit("K")), F.lit("")).alias("previous"),
    )


def with_second_release(raw: DataFrame) -> DataFrame:
    """Every day gets a second release with its actual and previous figure exchanged."""
    second = raw.select(
        "release_date",
        F.lit(SECOND_RELEASE_TIME).alias("release_time"),
        F.col("previous").alias("actual"),
        "forecast",
        F.col("actual").alias("previous"),
    )
    return raw.unionByName(second)


def with_header(raw: DataFrame) -> DataFrame:
    """Put a header row in front, as the text feed has it."""
    header = raw.sparkSession.createDataFrame(
        [("Release Date", "Time", "Actual", "Forecast", "Previous")], RAW_RELEASES
    )
    return header.unionByName(raw)


def gap_lines_of(source: DataFrame) -> DataFrame:
    """A report line for every two neighbouring quotes of a pair, which may hold a third of all quotes."""
    ticks = with_next(ticks_of(source).select("curr_pair", "ts"), "curr_pair", "ts", "nx")
    nx = F.col("nx")
    seconds = F.date_diff(nx.cast("date"), F.col("ts").cast("date")) * 86400 + (
        _second_of_day(nx) - _second_of_day(F.col("ts"))
    )
    return ticks.where(nx.isNotNull()).select(
        "curr_pair",
        F.concat(
            F.lit("Gap of "),
            seconds,
            F.lit("s found between "),
            second_text(F.col("ts")),
            F.lit(" and "),
            second_text(nx),
            F.lit("."),
        ).alias("line"),
    )


def _second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def with_dense_releases(raw: DataFrame) -> DataFrame:
    """A release every half hour of a day, all with the figures of the day's release."""
    rows = raw.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(47))))
    half = F.col("slot")
    clock = F.format_string("%02d:%02d", (half / 2).cast("int"), half % 2 * 30)
    return rows.withColumn("release_time", clock).drop("slot")
