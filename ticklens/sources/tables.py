"""Typed tables, by path or by catalog name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ticklens.schemas import GAPS, REJECTS, RELEASES, TICKS
from ticklens.sinks.tables import quoted


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Quotes at rest. The schema keeps partition values such as the day as text."""
    return spark.read.schema(TICKS).parquet(path)


def quoted_days(spark: SparkSession, path: str) -> DataFrame:
    """(curr_pair, day) with quotes, of a table partitioned by both: no column is read."""
    return read_ticks(spark, path).select("curr_pair", "day").distinct()


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RELEASES).parquet(path)


def read_gaps(spark: SparkSession, path: str, end_day: bool = False) -> DataFrame:
    schema = T.StructType([f for f in GAPS if end_day or f.name != "end_day"])
    return spark.read.schema(schema).parquet(path)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines that loads have rejected, with their feed, file and reason."""
    return spark.read.schema(REJECTS).parquet(path)


def read_table(spark: SparkSession, name: str, columns: list[str]) -> DataFrame:
    """Only the named columns of a catalog table."""
    return spark.table(name).select(*columns)


def read_current(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or view as it is now, whichever session has changed its files."""
    spark.catalog.refreshTable(quoted(name))
    return spark.table(quoted(name))
