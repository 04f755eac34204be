"""Typed tables at rest and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.schemas import RELEASES, TICKS


def write_releases(releases: DataFrame, path: str) -> None:
    """Overwrite the release table."""
    releases.select(*RELEASES.names).write.mode("overwrite").parquet(path)


def write_ticks(
    ticks: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = ("curr_pair", "day"),
    rebalance: bool = True,
) -> None:
    """Overwrite the partitions that `ticks` holds; all others stay as they are.

    Partitions by pair and day let a join with the releases skip the files of all other days. `rebalance` gathers each
    partition into files of even size, splits those of a large one, and sorts files by time, so that
    the hours of a file say whether it has to be read. Partitioning by pair alone, without it, needs no shuffle.
    """
    columns = ticks.select(*TICKS.names)
    if rebalance:
        columns = columns.hint("rebalance", *map(F.col, partition_by))
        columns = columns.sortWithinPartitions(*partition_by, "ts")
    (
        columns.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def write_gaps(gaps: DataFrame, path: str) -> None:
    """Overwrite the gaps of the pairs that are given."""
    (
        gaps.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("curr_pair")
        .parquet(path)
    )


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Add rejected lines to their table."""
    rejects.write.mode("append").partitionBy("feed").parquet(path)


def quoted(name: str) -> str:
    """A name for SQL text, whatever characters it has; dots separate its parts."""
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def text_literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    where = f" LOCATION {text_literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}{where}")


def register_table(
    spark: SparkSession,
    name: str,
    path: str,
    schema: T.StructType,
    partition_by: tuple[str, ...] = (),
) -> None:
    """Give a written directory, with all its partitions, a catalog name."""
    columns = ", ".join(f"{_column(f.name)} {f.dataType.simpleString()}" for f in schema)
    names = ", ".join(map(_column, partition_by))
    partitions = f" PARTITIONED BY ({names})" if partition_by else ""
    where = f"LOCATION {text_literal(path)}"
    spark.sql(f"CREATE TABLE {quoted(name)} ({columns}) USING parquet{partitions} {where}")
    if partition_by:
        spark.sql(f"ALTER TABLE {quoted(name)} RECOVER PARTITIONS")


def _column(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def create_release_view(spark: SparkSession, name: str, table: str) -> None:
    """Store the release history as a view in the catalog: day, time label and figures of a release table.

    It is a definition, so it shows whatever the table holds when it is read, in any session of the catalog.
    """
    columns = {
        "trading_day": "trading_day",
        "trading_time": "concat(trading_hour, ':', trading_min)",
        **{figure: figure for figure in ("actual", "forecast", "previous")},
    }
    fields = {f.name: f.dataType for f in RELEASES}
    listed = ", ".join(
        f"CAST({sql} AS {fields.get(column, T.StringType()).simpleString()}) AS {_column(column)}"
        for column, sql in columns.items()
    )
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(name)} AS SELECT {listed} FROM {quoted(table)}")


def save_table(
    df: DataFrame,
    name: str,
    mode: str = "errorifexists",
    files: int | None = None,
    path: str | None = None,
) -> None:
    """Save under a catalog name, with `path` as an external table.

    `files` limits the number of output files, and with it the tasks that write
    them; by default the result keeps its own.
    """
    result = df if files is None else df.coalesce(files)
    writer = result.write.mode(mode).format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(quoted(name))
