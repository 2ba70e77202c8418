"""Object storage as tables: reading, listing, writing, checkpoints of finished work."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_path(root: str, relative: str) -> str:
    """The path under root; one that would leave it is refused."""
    parts = [p for p in relative.replace("\\", "/").split("/") if p not in ("", ".")]
    if ".." in parts or "://" in relative:
        raise ValueError(f"{relative} leaves the storage")
    return "/".join([root.rstrip("/"), *parts])


def objects(spark: SparkSession, root: str, prefix: str = "", pattern: str = "*") -> DataFrame:
    """(path, size_bytes, modified_time) of all files under a prefix; contents are not read."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(safe_path(root, prefix))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, size_bytes long, modified_time timestamp")
    return found.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_time"))


def delete_prefix(spark: SparkSession, root: str, prefix: str) -> int:
    """Deletes everything whose path begins with the prefix, and tells how many files or folders that were at its level."""
    at = safe_path(root, prefix)
    if at == root.rstrip("/"):
        raise ValueError("an empty prefix would delete the storage")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(path(re.sub(r"([\\*?\[\]{}])", r"\\\1", at) + "*")) or []
    return sum(fs.delete(f.getPath(), True) for f in found)


def document_prefixes(partition: Column, document_id: Column) -> Column:
    """Where a document's raw file, processed texts and checkpoints lie in a knowledge base's storage."""
    return F.array(*[F.concat(partition, F.lit(f"/{kind}/"), document_id.cast("string")) for kind in ("raw", "processed", "checkpoints")])


def exist(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Wanted paths with ``there``, by a listing of ``objects``."""
    return wanted.join(found.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def contents(spark: SparkSession, root: str, prefix: str = "", pattern: str = "*") -> DataFrame:
    """(path, file_name, content, sha256)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(safe_path(root, prefix))
    return found.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "content", F.sha2("content", 256).alias("sha256"))


def as_text(content: Column) -> Column:
    """Bytes as UTF-8; where they are not, as Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def texts(spark: SparkSession, root: str, prefix: str = "", pattern: str = "*") -> DataFrame:
    return contents(spark, root, prefix, pattern).select("path", "file_name", as_text(F.col("content")).alias("text"), "sha256")


def events_from_json(spark: SparkSession, path: str) -> DataFrame:
    """A log of events as JSON lines: the envelope's columns, payload and metadata open."""
    raw = spark.read.text(path)
    v = F.try_parse_json("value")
    get = lambda p, t: F.try_variant_get(v, p, t)
    return raw.select(
        get("$.event_id", "string").alias("event_id"), get("$.aggregate_id", "string").alias("aggregate_id"), get("$.aggregate_type", "string").alias("aggregate_type"),
        get("$.event_type", "string").alias("event_type"), get("$.event_version", "int").alias("event_version"), F.to_timestamp(get("$.occurred_at", "string")).alias("occurred_at"),
        F.to_json(F.try_variant_get(v, "$.payload", "variant")).alias("payload"), F.to_json(F.try_variant_get(v, "$.metadata", "variant")).alias("metadata"),
    ).filter("event_id is not null")


def events_of(log: DataFrame, aggregate_id: object) -> DataFrame:
    """One aggregate's events in order."""
    return log.filter(F.col("aggregate_id") == aggregate_id).orderBy("event_version")


def save_checkpoint(done: DataFrame, root: str, name: str) -> None:
    """Appends finished work (kb_id, document_id, ...), partitioned so that a document's rows can be found."""
    done.write.mode("append").partitionBy("kb_id", "document_id").parquet(safe_path(root, f"checkpoints/{name}"))


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without what a checkpoint holds."""
    return work.join(done.select(*keys), keys, "left_anti")


# Names of stored parts.
def page_name(page: Column) -> Column:
    return F.concat(F.lit("page_"), F.lpad(page.cast("string"), 4, "0"), F.lit(".md"))


def part_name(parent_id: Column) -> Column:
    return F.concat(F.translate(parent_id, "/:", "__"), F.lit(".json"))


def page_of(path: Column) -> Column:
    """The page whose checkpoint a path is, null for other paths."""
    return F.nullif(F.regexp_extract(path, r"page_(\d+)\.md$", 1), F.lit("")).cast("int")


def completed_pages(paths: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, n_pages, completed, complete): how many pages of documents (document_id, n_pages) are in a listing of
    checkpoints (document_id, path)."""
    done = paths.withColumn("page", page_of(F.col("path"))).filter("page is not null").select("document_id", "page").distinct()
    n = done.join(documents, "document_id").filter(F.col("page").between(1, F.col("n_pages"))).groupBy("document_id").agg(F.count("*").alias("completed"))
    return documents.join(n, "document_id", "left").withColumn("completed", F.coalesce("completed", F.lit(0))).withColumn("complete", F.col("completed") == F.col("n_pages"))


def missing_pages(documents: DataFrame, done: DataFrame) -> DataFrame:
    """(document_id, page) still to be done: every page of documents (document_id, n_pages) without a row in ``done``."""
    every = documents.filter("n_pages > 0").select("document_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page"))
    return every.join(done.select("document_id", "page"), ["document_id", "page"], "left_anti")


def recognize(pages: DataFrame, done: DataFrame, model) -> DataFrame:
    """(document_id, page, markdown) of all pages (document_id, page, image): what is done is taken, the rest goes through
    ``model``, a column function. Pages whose model gives null are left out, to be done by a later run."""
    fresh = pages.join(done.select("document_id", "page"), ["document_id", "page"], "left_anti").select("document_id", "page", model(F.col("image")).alias("markdown"))
    return done.select("document_id", "page", "markdown").unionByName(fresh.filter("markdown is not null"))


def assemble_pages(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(document_id, text, n_pages) from (document_id, page, markdown), pages in ascending order."""
    p = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page", "markdown"))).alias("pages"))
    return p.select("document_id", F.array_join(F.transform("pages", lambda x: x["markdown"]), separator).alias("text"), F.size("pages").cast("long").alias("n_pages"))
