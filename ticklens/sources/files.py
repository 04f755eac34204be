"""Raw text feeds. Schemas are declared; nothing is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.schemas import RAW_RELEASES, RAW_TICKS

# The delimiters of the feeds and the mark of a missing text.
TICK_DELIMITER = ","
RELEASE_DELIMITER = "|"
NULL_TEXT = r"\N"

_PAIR = T.StructField("curr_pair", T.StringType())


def read_raw_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Quotes below `curr_pair=<pair>` directories; a filter on the pair prunes them."""
    schema = T.StructType([*RAW_TICKS, _PAIR])
    return spark.read.schema(schema).csv(path, sep=TICK_DELIMITER)


def read_raw_ticks_from(spark: SparkSession, directories: dict[str, str]) -> DataFrame:
    """Quotes from one directory per pair, whatever the directories are called."""
    feeds = [
        spark.read.schema(RAW_TICKS)
        .csv(path, sep=TICK_DELIMITER)
        .withColumn("curr_pair", F.lit(pair))
        for pair, path in directories.items()
    ]
    return reduce(DataFrame.unionByName, feeds)


def read_raw_releases(spark: SparkSession, path: str) -> DataFrame:
    """Releases as text, header rows included.

    Lines are split by hand because an empty field is an empty text here, and only
    a field that is not there at all is NULL. Quotation marks mean nothing.
    """
    fields = F.split("value", r"\|")
    columns = [
        F.nullif(F.get(fields, F.lit(i)), F.lit(NULL_TEXT)).alias(name)
        for i, name in enumerate(RAW_RELEASES.names)
    ]
    return spark.read.text(path).select(*columns)


def read_gap_lines(spark: SparkSession, path: str) -> DataFrame:
    """Gap report lines below `curr_pair=<pair>` directories."""
    schema = T.StructType([T.StructField("line", T.StringType()), _PAIR])
    return spark.read.schema(schema).text(path)


def read_gap_lines_of(spark: SparkSession, path: str, pair: str) -> DataFrame:
    """Gap report lines of one pair."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.lit(pair).alias("curr_pair")
    )


def read_lines(spark: SparkSession, path: str, pair: str | None = None) -> DataFrame:
    """(curr_pair, file, line): lines with the file they are in, for feeds that are checked line by line.

    The pair is given, or read off `curr_pair=<pair>` directories, or NULL.
    """
    schema = T.StructType([T.StructField("line", T.StringType()), _PAIR])
    lines = spark.read.text(path) if pair else spark.read.schema(schema).text(path)
    lines = lines.withColumn("file", F.col("_metadata.file_path"))
    if pair:
        return lines.select(F.lit(pair).alias("curr_pair"), "file", F.col("value").alias("line"))
    return lines.select("curr_pair", "file", "line")
