"""Hand-made inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.operators.clean import clean_releases, clean_ticks
from ticklens.schemas import PRICE, RAW_RELEASES

RELEASES = """\
Release Date|Time|Actual|Forecast|Previous
Jan 04, 2008|08:30|18K|70K|115K
Feb 01, 2008|08:30|-17K||18K
Mar 07, 2008|23:58|1K|1K|1K
Release Date|Time|Actual|Forecast|Previous
Apr 04, 2008|08:30|2K|2K|2K
Apr 04, 2008|10:00|3K|3K|3K
Xyz 02, 2008|08:30|1K|1K|1K
"""

TICKS = """\
20080104 082959999,EURUSD,1.470000
20080104 083000000,EURUSD,1.471000
20080104 083000001,EURUSD,1.472000
20080104 083030000,EURUSD,1.475000
20080104 083045000,EURUSD,1.475000
20080104 083050000,EURUSD,1.469000
20080104 083100000,EURUSD,1.474000
20080104 083459999,EURUSD,1.473000
20080104 083500000,EURUSD,1.480000
20080104 090000000,GBPUSD,1.970000
20080201 083010000,EURUSD,1.481000
20080201 083010000,EURUSD,1.482000
20080307 235900000,EURUSD,1.500000
20080308 000100000,EURUSD,1.600000
20080404 083010000,EURUSD,1.570000
20080404 100010000,EURUSD,1.580000
"""

GAPS = """\
Gap of 61s found between 20080104083000 and 20080104083101.
Gap of 0s found between 20080104090000 and 20080104090000.
Gap of 120s found between 20080104235900 and 20080105000100.
some header text
xx Gap of 61s found between 20080104083000 and 20080104083101.
"""


def raw_releases(spark: SparkSession) -> DataFrame:
    rows = [tuple(line.split("|")) for line in RELEASES.splitlines()]
    return spark.createDataFrame(rows, RAW_RELEASES)


def releases(spark: SparkSession) -> DataFrame:
    return clean_releases(raw_releases(spark))


def ticks(spark: SparkSession) -> DataFrame:
    """The price serves as bid and as ask."""
    rows = [tuple(line.split(",")) for line in TICKS.splitlines()]
    price = F.col("price").cast(PRICE)
    raw = spark.createDataFrame(rows, "trade_dt string, curr_pair string, price string").select(
        "trade_dt", price.alias("bid"), price.alias("ask"), "curr_pair"
    )
    return clean_ticks(raw)
