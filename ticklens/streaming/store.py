"""The stored segments of an incremental load: a log of generations over directories of rows.

    <path>/data/<name>/             rows, written once and never changed
    <path>/log/generation=<n>/      one small file: what generation n adds, or what it starts anew with

A generation counts from the moment its file is there, which is one rename; what it names has been written before. So
whatever step fails, readers see the state before or after it, and a directory that no generation names is waste.
Compaction merges all rows into one directory and starts the log anew from it. Files are dropped one
compaction later, so a reader that has planned its scan can finish it.

One job writes to a store at a time; any number may read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ADD, START, CALENDAR, DROP = "add", "start", "calendar", "drop"
_LOG = "generation bigint, kind string, name string, note string"


@dataclass
class State:
    """What the log says: the generation, the directories that count, the calendar, and what may go."""

    generation: int = 0
    names: list[str] = field(default_factory=list)
    calendar: str | None = None
    #: Directories that the last start of the log has replaced.
    replaced: list[str] = field(default_factory=list)


class SegmentStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _log(self) -> list[tuple[int, str, str, str]]:
        """All entries; there are as many as additions since the last compaction."""
        try:
            rows = self.spark.read.schema(_LOG).json(f"{self.path}/log").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []  # nothing has been stored yet
        return sorted((r.generation, r.kind, r.name, r.note) for r in rows)

    def state(self) -> State:
        state, log = State(), self._log()
        started = max((g for g, kind, *_ in log if kind == START), default=0)
        for generation, kind, name, _ in log:
            state.generation = max(state.generation, generation)
            if generation < started:
                continue
            if kind in (ADD, START) and name:
                state.names.append(name)
            elif kind == CALENDAR:
                state.calendar = name
            elif kind == DROP:
                state.replaced.append(name)
        return state

    def commit(self, after: int, entries: list[tuple[str, str, str]]) -> None:
        """Make the next generation of these (kind, name, note): one file, so all of it or nothing is seen."""
        rows = self.spark.createDataFrame(entries, "kind string, name string, note string")
        # A writer that was lost may have left the directory of this generation, without the file.
        rows.coalesce(1).write.mode("append").json(f"{self.path}/log/generation={after + 1}")

    def write(self, df: DataFrame, files: int | None = None) -> str:
        """Write rows to a directory of their own that no generation names yet; return its name."""
        name = uuid.uuid4().hex
        (df if files is None else df.repartition(files)).write.parquet(f"{self.path}/data/{name}")
        return name

    def read_names(self, names: list[str], schema: T.StructType | None = None) -> DataFrame:
        schema = schema or self.schema
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{n}" for n in names))

    def read(self, state: State | None = None) -> DataFrame:
        """All rows that count; none if nothing has been stored."""
        return self.read_names((state or self.state()).names)

    def append(self, df: DataFrame, note: str = "") -> None:
        name = self.write(df)
        self.commit(self.state().generation, [(ADD, name, note)])

    def replace(self, state: State, df: DataFrame, files: int | None = None) -> None:
        """Start the log anew from `df`, the rows of `state` in another form, and what was added since."""
        name = self.write(df, files)
        now = self.state()
        later = [n for n in now.names if n not in set(state.names)]
        entries = [(START, n, "compacted") for n in (name, *later)]
        entries += [(DROP, n, "") for n in state.names]
        if now.calendar:
            entries.append((CALENDAR, now.calendar, ""))
        self.commit(now.generation, entries)

    def vacuum(self, keep_replaced: bool = True) -> int:
        """Delete what no reader needs; returns the number of directories that have gone.

        What the last compaction has replaced stays for readers that began before it, unless told otherwise.
        """
        state = self.state()
        needed = {*state.names, state.calendar} | (set(state.replaced) if keep_replaced else set())
        gone = 0
        for directory in _directories(f"{self.path}/data"):
            if directory.rsplit("/", 1)[1] not in needed:
                _delete(directory)
                gone += 1
        log = self._log()
        started = max((g for g, kind, *_ in log if kind == START), default=0)
        for generation in {g for g, *_ in log if g < started}:
            _delete(f"{self.path}/log/generation={generation}")
        return gone


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _directories(path: str) -> list[str]:
    system, inner = _filesystem(path)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return [prefix + f.path for f in found if f.type == fs.FileType.Directory]


def _delete(path: str) -> None:
    system, inner = _filesystem(path)
    system.delete_dir(inner)
