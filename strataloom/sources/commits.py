"""A table that is written by commits: appends, upserts and deletes that happen whole or not at all, and only once.

    commits.register(spark)
    df.write.format("strataloom_commits").option("path", at).option("expected", 7).mode("append").save()

A Python data source does the writing. Tasks write attempt files of their own names; ``commit`` publishes one manifest,
numbered after the version that the writer expected, by a rename that fails where such a manifest is there already, so of
two writers with one expectation one wins and the other's files go. ``abort`` removes the files of a job that failed. A
manifest names the files it adds, and every tenth all files, so a reader opens ten manifests at most. A stream's manifests
name the last batch of each stream, so a batch that is delivered again changes nothing.

Manifests are published on file systems whose rename doesn't replace: local or mounted ones and HDFS.
"""

from __future__ import annotations

import contextlib
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import IntegerType, StructField, StructType

from strataloom import importable
from strataloom.operators import events, graph

FORMAT = "strataloom_commits"
#: A manifest names all files, not only its own, each so many versions.
WHOLE = 10
#: Times that ``append_events`` and the like try anew when another writer was first.
TRIES = 20
_CONFLICT = "strataloom: another commit was first"


class Conflict(RuntimeError):
    """The table isn't at the version that the writer expected."""


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _publish(store, base: str, version: int, manifest: dict) -> bool:
    """Writes a manifest unless one of this version is there."""
    target, attempt = f"{base}/manifests/{version:020d}.json", f"{base}/manifests/.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as f:
        f.write(json.dumps(manifest).encode())
    if store.type_name == "local":
        try:
            os.link(attempt, target)  # fails where the target is there
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(attempt)
    if store.type_name != "hdfs":
        store.delete_file(attempt)
        raise NotImplementedError(f"no exclusive rename on {store.type_name}")
    try:
        store.move(attempt, target)
        return True
    except OSError:
        with contextlib.suppress(OSError):
            store.delete_file(attempt)
        return False


@dataclass(frozen=True)
class State:
    """A version of the table: its files, and of each stream the last batch."""

    version: int = 0
    files: tuple[str, ...] = ()
    streams: dict[str, int] = field(default_factory=dict)


def state(path: str, version: int | None = None) -> State:
    """The table as of a version, by default the last one. A folder without manifests is an empty table of version 0."""
    from pyarrow import fs

    store, base = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{base}/manifests", allow_not_found=True))
    numbers = sorted(int(f.base_name[:20]) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))
    numbers = [n for n in numbers if version is None or n <= version]
    added: list[list[str]] = []
    streams: dict[str, int] = {}
    for k, n in enumerate(reversed(numbers)):
        with store.open_input_stream(f"{base}/manifests/{n:020d}.json") as f:
            m = json.loads(f.read())
        streams = streams if k else m["streams"]
        added.append(m["files"])
        if m["whole"]:
            break
    return State(numbers[-1] if numbers else 0, tuple(x for own in reversed(added) for x in own), streams)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer:
    """What batch and stream writers share."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.stream = options["path"], overwrite, options.get("stream", "")
        self.schema = schema
        expected = options.get("expected")
        self.expected = None if expected is None else int(expected)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file of this attempt; a task without rows writes none. Its file goes if the task fails."""
        store, base = _store(self.path)
        name, out = f"data/{uuid.uuid4().hex}.parquet", None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    store.create_dir(f"{base}/data", recursive=True)
                    out = pq.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=store, compression="zstd")
                out.write_batch(batch)
            if out:
                out.close()
        except BaseException:
            if out:
                with contextlib.suppress(Exception):
                    out.close()
                with contextlib.suppress(OSError):
                    store.delete_file(f"{base}/{name}")
            raise
        return Written([name] if out else [])

    def _remove(self, messages: list) -> None:
        store, base = _store(self.path)
        for m in messages:
            for name in m.files if m else []:
                with contextlib.suppress(OSError):
                    store.delete_file(f"{base}/{name}")

    def _commit(self, messages: list, batch: int | None = None) -> None:
        store, base = _store(self.path)
        store.create_dir(f"{base}/manifests", recursive=True)
        files = [name for m in messages if m for name in m.files]
        for _ in range(TRIES):
            now = state(self.path)
            if batch is not None and now.streams.get(self.stream, -1) >= batch:
                self._remove(messages)  # the batch was committed before
                return
            if self.expected is not None and now.version != self.expected:
                break
            whole = self.overwrite or (now.version + 1) % WHOLE == 0
            kept = [] if self.overwrite else list(now.files)
            manifest = {"version": now.version + 1, "at": time.time(), "whole": whole, "files": kept + files if whole else files, "streams": now.streams | ({self.stream: batch} if batch is not None else {})}
            if _publish(store, base, now.version + 1, manifest):
                return
        self._remove(messages)
        raise Conflict(f"{_CONFLICT}: expected version {self.expected}")


class _Batch(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages)

    def abort(self, messages: list) -> None:
        self._remove(messages)


class _Stream(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self._remove(messages)


class Commits(DataSource):
    """Options: path; expected, the version that the table must have; stream, a name, for streams."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Batch(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Stream(self.options, schema, False)


_registering = threading.Lock()


def register(spark: SparkSession) -> None:
    importable(spark)
    with _registering:  # Spark replaces a source of the same name, but not from two threads at once
        spark.dataSource.register(Commits)


def read(spark: SparkSession, path: str, schema: str | StructType, version: int | None = None) -> tuple[DataFrame, int]:
    """(rows, version) of the table. Its files are read by Spark, pruned and pushed down as those of any Parquet table."""
    now = state(path, version)
    df = spark.read.schema(schema).parquet(*[f"{path}/{name}" for name in now.files]) if now.files else spark.createDataFrame([], schema)
    return df, now.version


def write(df: DataFrame, path: str, expected: int | None = None, overwrite: bool = False) -> None:
    """Commits the rows of df; Conflict if the table isn't at the expected version."""
    register(df.sparkSession)
    w = df.write.format(FORMAT).option("path", path).mode("overwrite" if overwrite else "append")
    try:
        (w if expected is None else w.option("expected", expected)).save()
    except Exception as e:
        if _CONFLICT in str(e):
            raise Conflict(str(e)[:200]) from e
        raise


def _again(path: str, schema: str | StructType, spark: SparkSession, change: Callable[[DataFrame], DataFrame], overwrite: bool) -> None:
    """Reads, changes and commits, anew from the reading on whenever another writer was first."""
    for k in range(TRIES):
        rows, version = read(spark, path, schema)
        try:
            return write(change(rows), path, version, overwrite)
        except Conflict:
            if k == TRIES - 1:
                raise


def append_events(batch: DataFrame, path: str) -> None:
    """Appends events (aggregate_id, seq, and others) with versions that continue each aggregate's, whoever else appends."""
    schema = StructType([*[f for f in batch.schema.fields if f.name != "event_version"], StructField("event_version", IntegerType())])
    names = [f.name for f in schema.fields]
    _again(path, schema, batch.sparkSession, lambda log: events.number_events(batch.drop("event_version"), log).select(*names), False)


def upsert(rows: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Of each key the last row by ``order``, of those there and the new ones; the whole table is written anew."""
    others = [c for c in rows.columns if c not in (*keys, order)]
    _again(path, rows.schema, rows.sparkSession, lambda there: graph.latest(there.unionByName(rows), keys, order, [order, *others]).select(*rows.columns), True)


def delete(keys: DataFrame, path: str, schema: str | StructType) -> None:
    """The table without the rows whose key is among ``keys``, by the columns of that table."""
    _again(path, schema, keys.sparkSession, lambda there: there.join(keys.distinct(), keys.columns, "left_anti").select(*there.columns), True)


def clean_up(path: str, older_than: float) -> int:
    """Removes data files that no manifest since the last whole one names and that are older than so many seconds: what
    killed attempts, replaced tables and conflicts of killed drivers left behind. Earlier versions can't be read after."""
    from pyarrow import fs

    store, base = _store(path)
    held = set(state(path).files)
    gone = [f for f in store.get_file_info(fs.FileSelector(f"{base}/data", allow_not_found=True)) if f"data/{f.base_name}" not in held and f.mtime.timestamp() < time.time() - older_than]
    for f in gone:
        store.delete_file(f.path)
    return len(gone)
