"""An event log as a table that is bucketed by aggregate and sorted by version.

Looking up an aggregate reads one bucket, and in it the row groups whose statistics and Bloom filter may hold the id. Folds
by aggregate, numbering of appended events and joins of two such logs need no exchange, since all events of an aggregate lie
in one bucket. The number of buckets is fixed at creation and bounds the parallelism of such folds; choose it by the size
that the log will have, some hundred megabytes a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Rows of a row group: a lookup reads one, or a few.
BLOCK_BYTES = 16 << 20


def _writer(log: DataFrame, buckets: int):
    # one file a bucket and append; rows of an aggregate in order
    placed = log.repartition(buckets, "aggregate_id").sortWithinPartitions("aggregate_id", "event_version")
    return (
        placed.write.format("parquet").option("parquet.bloom.filter.enabled#aggregate_id", "true").option("parquet.block.size", BLOCK_BYTES)
        .bucketBy(buckets, "aggregate_id").sortBy("aggregate_id", "event_version")
    )


def create(log: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Stores a log (aggregate_id, event_version, ...) as table ``name`` below ``path``, a folder that all executors share."""
    _writer(log, buckets).option("path", path).saveAsTable(name)
    return log.sparkSession.table(name)


def append(batch: DataFrame, name: str) -> None:
    """Adds events, one file for each bucket that gets some. Versions must continue the log, as ``events.number_events``
    gives them; ``sources.commits`` is the way for writers that compete."""
    spark = batch.sparkSession
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    _writer(batch.select(*spark.table(name).columns), int(described["Num Buckets"])).mode("append").saveAsTable(name)


def events_of(spark: SparkSession, name: str, aggregate_id: object) -> DataFrame:
    """One aggregate's events in order: one bucket is read."""
    kind = spark.table(name).schema["aggregate_id"].dataType
    return spark.table(name).filter(F.col("aggregate_id") == F.lit(aggregate_id).cast(kind)).orderBy("event_version")


def tail(spark: SparkSession, name: str, seen: DataFrame) -> DataFrame:
    """Events after the last version that ``seen`` (aggregate_id, event_version) has of each aggregate."""
    last = seen.groupBy("aggregate_id").agg(F.max("event_version").alias("seen"))
    return spark.table(name).join(last, "aggregate_id", "left").filter(F.col("event_version") > F.coalesce("seen", F.lit(0))).drop("seen")
