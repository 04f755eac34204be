"""Column names and types of every table the package reads or writes."""

from pyspark.sql import types as T

PRICE = T.DecimalType(12, 6)

# Quotes as they arrive: one text line per quote, one directory per pair.
RAW_TICKS = T.StructType(
    [
        T.StructField("trade_dt", T.StringType()),
        T.StructField("bid", PRICE),
        T.StructField("ask", PRICE),
        T.StructField("vol", T.ByteType()),
    ]
)

# Quotes at rest. `ts` is stored so that no reader has to rebuild it from text.
TICKS = T.StructType(
    [
        T.StructField("trade_dt", T.StringType()),
        T.StructField("day", T.StringType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("min", T.IntegerType()),
        T.StructField("sec", T.IntegerType()),
        T.StructField("milli", T.IntegerType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("bid", PRICE),
        T.StructField("ask", PRICE),
        T.StructField("curr_pair", T.StringType()),
    ]
)

RAW_RELEASES = T.StructType(
    [
        T.StructField("release_date", T.StringType()),
        T.StructField("release_time", T.StringType()),
        T.StructField("actual", T.StringType()),
        T.StructField("forecast", T.StringType()),
        T.StructField("previous", T.StringType()),
    ]
)

RELEASES = T.StructType(
    [
        T.StructField("release_date", T.StringType()),
        T.StructField("release_time", T.StringType()),
        T.StructField("actual", T.IntegerType()),
        T.StructField("forecast", T.IntegerType()),
        T.StructField("previous", T.IntegerType()),
        T.StructField("trading_day", T.StringType()),
        T.StructField("trading_hour", T.IntegerType()),
        T.StructField("trading_min", T.IntegerType()),
    ]
)

GAPS = T.StructType(
    [
        T.StructField("gap", T.IntegerType()),
        *(
            T.StructField(name, T.StringType())
            for name in (
                *("day", "start_hour", "start_min", "start_sec"),
                *("end_hour", "end_min", "end_sec", "end_day"),
            )
        ),
        T.StructField("curr_pair", T.StringType()),
    ]
)

# Lines that became no row of a table.
REJECTS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("curr_pair", "file", "line", "reason", "feed")
    ]
)

# What a join or a group needs to know about a release.
RELEASE_TIME = ["trading_day", "trading_hour", "trading_min"]
RELEASE_FACTS = ["previous", "forecast", "actual"]

# One row of any reaction result: a pair and a release.
GROUP = ["curr_pair", "day", "trading_hour", "trading_min"]
