"""What a folder source holds: a walk over folders and shortcuts, files as items, and what came and went since a cursor.

A listing has file_id, parent_id, name, mime_type, modified_time (text), size, md5, version, shortcut_target,
shortcut_mime, and trashed; missing columns count as null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The types of folders and shortcuts, and what native documents are exported as.
FOLDER, SHORTCUT = "application/vnd.google-apps.folder", "application/vnd.google-apps.shortcut"
EXPORTS = {"application/vnd.google-apps.document": "text/plain", "application/vnd.google-apps.spreadsheet": "text/csv"}

_COLUMNS = {"file_id": "string", "parent_id": "string", "name": "string", "mime_type": "string", "modified_time": "string", "size": "long", "md5": "string", "version": "string", "shortcut_target": "string", "shortcut_mime": "string", "trashed": "boolean"}


def listing(files: DataFrame) -> DataFrame:
    return files.select(*[(F.col(c).cast(t) if c in files.columns else F.lit(None).cast(t)).alias(c) for c, t in _COLUMNS.items()])


def time_of(text: Column, now: Column) -> Column:
    """An ISO 8601 time; ``now`` where there is none or it can't be read."""
    return F.coalesce(F.try_to_timestamp(text), now)


def version_hash(md5: Column, version: Column, modified: Column) -> Column:
    """The first that is filled: checksum, version, whole seconds of the time."""
    filled = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(filled(md5), filled(version), F.unix_timestamp(modified).cast("string"))


def items(files: DataFrame, mimes: list[str], now: Column) -> DataFrame:
    """Files as (external_id, name, mime_type, version_hash, modified_time, size_bytes, parent_id).

    A shortcut stands for its target; folders, shortcuts to folders or to nothing, and types that aren't asked for
    are left out. An empty list of types takes all."""
    short = F.col("mime_type") == SHORTCUT
    a = listing(files).withColumns({"external_id": F.when(short, F.nullif("shortcut_target", F.lit(""))).otherwise(F.col("file_id")), "mime_type": F.when(short, F.col("shortcut_mime")).otherwise(F.col("mime_type"))})
    a = a.filter(F.col("external_id").isNotNull() & ~F.coalesce(F.col("mime_type") == FOLDER, F.lit(False)))
    a = a.filter(F.coalesce(F.col("mime_type").isin(*mimes), F.lit(False))) if mimes else a
    a = a.withColumn("modified_time", time_of(F.col("modified_time"), now))
    return a.select("external_id", F.coalesce("name", "external_id").alias("name"), "mime_type", version_hash(F.col("md5"), F.col("version"), F.col("modified_time")).alias("version_hash"), "modified_time", F.coalesce("size", F.lit(0)).alias("size_bytes"), "parent_id")


def walk(links: DataFrame, root: object, folder: str, recursive: bool = True) -> DataFrame:
    """(folder_id, depth) of every folder that links (parent_id, folder_id) reach from the root, each once.

    Level by level: the newly found are joined with the links and cut by those known, until none is new. So shared
    folders and cycles cost nothing, depth has no bound, and each level is a table below ``folder``, a place that all
    executors share.
    """
    spark = links.sparkSession
    at = f"{folder.rstrip('/')}/walk-{uuid.uuid4().hex}"
    kind = links.schema["folder_id"].dataType
    spark.range(1).select(F.lit(root).cast(kind).alias("folder_id"), F.lit(0).cast("long").alias("depth")).write.parquet(f"{at}/0")
    schema = spark.read.parquet(f"{at}/0").schema
    depth = 0
    while recursive:
        known, newest = spark.read.schema(schema).parquet(*[f"{at}/{k}" for k in range(depth + 1)]), spark.read.schema(schema).parquet(f"{at}/{depth}")
        found = links.join(newest.select(F.col("folder_id").alias("parent_id")), "parent_id", "left_semi").select("folder_id").filter("folder_id is not null").distinct()
        depth += 1
        found.join(known.select("folder_id"), "folder_id", "left_anti").withColumn("depth", F.lit(depth).cast("long")).write.parquet(f"{at}/{depth}")
        if spark.read.schema(schema).parquet(f"{at}/{depth}").isEmpty():
            break
    return spark.read.schema(schema).parquet(*[f"{at}/{k}" for k in range(depth + 1)])


def folder_links(files: DataFrame) -> DataFrame:
    """(parent_id, folder_id) of folders and of shortcuts to folders."""
    a = listing(files).filter(~F.coalesce("trashed", F.lit(False)))
    own = a.filter(F.col("mime_type") == FOLDER).select("parent_id", F.col("file_id").alias("folder_id"))
    return own.unionByName(a.filter((F.col("mime_type") == SHORTCUT) & (F.col("shortcut_mime") == FOLDER)).select("parent_id", F.col("shortcut_target").alias("folder_id")))


def baseline(files: DataFrame, root: object, folder: str, mimes: list[str], days: int, now: Column, recursive: bool = True) -> DataFrame:
    """Every item below the root that is not older than ``days`` (0: no bound), each external_id once: that of the folder
    met first, of one folder the first by name."""
    reached = walk(folder_links(files), root, folder, recursive)
    live = listing(files).filter(~F.coalesce("trashed", F.lit(False)))
    a = items(live, mimes, now).join(reached.withColumnRenamed("folder_id", "parent_id"), "parent_id")
    a = a if days == 0 else a.filter(F.col("modified_time") >= now - F.make_dt_interval(days=F.lit(days)))
    columns = ["name", "mime_type", "version_hash", "modified_time", "size_bytes"]
    return a.groupBy("external_id").agg(F.min(F.struct("depth", "parent_id", *columns)).alias("first")).select("external_id", *[F.col(f"first.{c}") for c in columns])


def delta(changes: DataFrame, folders: DataFrame, mimes: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """(items, deleted ids) of a change feed: listing columns, removed and seq; each file's last change holds.

    Without ``removed`` nothing was removed; without ``seq`` each file has one change, and of several a removal holds.
    Kept are files in any of ``folders`` (folder_id), so that a feed follows the same tree as a baseline does."""
    names = list(_COLUMNS)
    removed = F.coalesce("removed", F.lit(False)) if "removed" in changes.columns else F.lit(False)
    trashed = F.coalesce("trashed", F.lit(False)) if "trashed" in changes.columns else F.lit(False)
    seq = F.col("seq") if "seq" in changes.columns else (removed | trashed).cast("int")
    rows = changes.select(*[(F.col(c).cast(t) if c in changes.columns else F.lit(None).cast(t)).alias(c) for c, t in _COLUMNS.items()], removed.alias("removed"), seq.alias("seq"))
    last = rows.groupBy("file_id").agg(F.max_by(F.struct(*[c for c in names if c != "file_id"], "removed"), "seq").alias("c")).select("file_id", "c.*")
    gone = F.col("removed") | F.coalesce("trashed", F.lit(False))
    inside = last.filter(~gone).join(folders.select(F.col("folder_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    return items(inside, mimes, now).drop("parent_id"), last.filter(gone).select("file_id")


def exported(mime: Column) -> Column:
    """The type as which a file is loaded: native documents are exported."""
    out = mime
    for k, v in EXPORTS.items():
        out = F.when(mime == k, v).otherwise(out)
    return out


def loaded(items_: DataFrame, contents: DataFrame) -> DataFrame:
    """Items with content, loaded_mime, loaded_hash and error, from contents (external_id, content); what is missing
    is an error of its row, and the run goes on."""
    a = items_.join(contents.select("external_id", "content"), "external_id", "left")
    return a.withColumns({"loaded_mime": exported(F.col("mime_type")), "loaded_hash": F.sha2("content", 256), "error": F.when(F.col("content").isNull(), F.concat(F.lit("no content of '"), "name", F.lit("'")))})


class Connectors:
    """Kinds of sources and how each lists and loads: ``list(source) -> listing``, ``load(items) -> items with content``."""

    def __init__(self) -> None:
        self.known: dict[str, object] = {}

    def add(self, kind: str, connector: object) -> None:
        self.known[kind] = connector

    def of(self, kind: str) -> object:
        if kind not in self.known:
            raise KeyError(f"no connector for {kind}")
        return self.known[kind]
