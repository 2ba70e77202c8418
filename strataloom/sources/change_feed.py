"""A folder as a feed of changes: a Python data source, batch and streaming, that tells what came, changed and went.

    spark.dataSource.register(LocalFolder)
    spark.readStream.format("local_folder").option("path", folder).load()

A stream compares listings: its offset names the listing of all files, with time and size, that was taken last, so files of
equal times, files that come with an old time, and removed files are all told. Listings are kept below the option
``state``, by default the hidden folder ``.changes`` of the path itself; path and state must be reachable by driver
and executors alike. The driver lists; files are read and hashed by the tasks. A batch read gives all files, or with
option ``since_ns`` those of a later time, or with option ``known``, a listing's path, what changed against it.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "external_id string, name string, version_hash string, modified_ns long, size_bytes long, removed boolean"
STATE = ".changes"
#: Files of a task.
CHUNK = 64

Listing = dict[str, list[int]]


def listing_of(path: str) -> Listing:
    """Time and size of every file below the path, hidden state aside."""
    out: Listing = {}
    for base, folders, names in os.walk(path):
        folders[:] = sorted(f for f in folders if f != STATE)
        for name in names:
            full = os.path.join(base, name)
            stat = os.stat(full)
            out[os.path.relpath(full, path)] = [stat.st_mtime_ns, stat.st_size]
    return out


class Files(InputPartition):
    def __init__(self, path: str, changed: list[str], removed: list[str]):
        super().__init__(None)
        self.path, self.changed, self.removed = path, changed, removed


def differences(path: str, before: Listing, after: Listing) -> list[InputPartition]:
    changed = sorted(k for k, v in after.items() if before.get(k) != v)
    removed = sorted(k for k in before if k not in after)
    parts: list[InputPartition] = [Files(path, changed[k : k + CHUNK], []) for k in range(0, len(changed), CHUNK)]
    return parts + [Files(path, [], removed[k : k + 64 * CHUNK]) for k in range(0, len(removed), 64 * CHUNK)] or [Files(path, [], [])]


def read_files(part: Files) -> Iterator[tuple]:
    """A row for each file; one that went since it was listed is told as removed."""
    for key in part.changed:
        try:
            with open(os.path.join(part.path, key), "rb") as f:
                stat = os.fstat(f.fileno())
                yield key, os.path.basename(key), hashlib.file_digest(f, "sha256").hexdigest(), stat.st_mtime_ns, stat.st_size, False
        except FileNotFoundError:
            yield key, os.path.basename(key), None, None, None, True
    for key in part.removed:
        yield key, os.path.basename(key), None, None, None, True


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, state: str):
        self.path, self.state = path, state
        self.last: tuple[dict, Listing] | None = None

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def _load(self, offset: dict) -> Listing:
        if not offset["listing"]:
            return {}
        with open(os.path.join(self.state, offset["listing"])) as f:
            return json.load(f)

    def latestOffset(self) -> dict:
        now = listing_of(self.path)
        if self.last is None or self.last[1] != now:
            os.makedirs(self.state, exist_ok=True)
            name = f"{uuid.uuid4().hex}.json"
            with open(os.path.join(self.state, name + ".part"), "w") as f:
                json.dump(now, f)
            os.replace(os.path.join(self.state, name + ".part"), os.path.join(self.state, name))
            self.last = {"listing": name}, now
        return self.last[0]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return differences(self.path, self._load(start), self._load(end))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return read_files(partition)

    def commit(self, end: dict) -> None:
        pass


class _Batch(DataSourceReader):
    def __init__(self, path: str, since: int, known: str | None):
        self.path, self.since, self.known = path, since, known

    def partitions(self) -> list[InputPartition]:
        now = listing_of(self.path)
        if self.known:
            with open(self.known) as f:
                return differences(self.path, json.load(f), now)
        return differences(self.path, {}, {k: v for k, v in now.items() if v[0] > self.since})

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return read_files(partition)


class LocalFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "local_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"], int(self.options.get("since_ns", -1)), self.options.get("known"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self.options.get("state", os.path.join(self.options["path"], STATE)))
