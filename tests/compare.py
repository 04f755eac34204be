"""Compare a Spark result with the result of its SQL in DuckDB."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame

TABLES = [
    *("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"),
    *("documents", "embeddings", "pages", "benchmark", "labels", "conversations"),
]

# Type names that mean the same in both engines.
_TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "tinyint": "TINYINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "decimal(12,6)": "DECIMAL(12,6)",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    rows = [tuple(row) for row in df.select(*names).collect()]
    return names, sorted(rows, key=repr)


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    result = con.execute(sql)
    columns = sorted((d[0], str(d[1]), i) for i, d in enumerate(result.description))
    rows = [tuple(row[i] for _, _, i in columns) for row in result.fetchall()]
    return [c[0] for c in columns], [c[1] for c in columns], sorted(rows, key=repr)


def assert_same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    names, rows = spark_rows(df)
    duck_names, duck_types, duck = duck_rows(con, sql)
    assert names == duck_names
    types = dict(df.dtypes)
    assert [_TYPES[types[n]] for n in names] == [t.upper() for t in duck_types]
    assert len(rows) == len(duck)
    for ours, theirs in zip(rows, duck):
        assert ours == theirs
    return len(rows)
