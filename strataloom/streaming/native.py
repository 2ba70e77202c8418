"""Windows over time and pages, and bounded runs of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.read_model import COLUMNS, with_payload
from strataloom.storage import shared_folder
from strataloom.streaming import projector


def windowed(events: DataFrame, time: str, width: str, keys: list[str]) -> DataFrame:
    """Counts and sums by tumbling window; the same plan runs on a stream with a watermark."""
    return events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def _drained(stream: DataFrame, mode: str, folder: str, collect) -> None:
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.outputMode(mode).foreachBatch(collect).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stream_documents(spark: SparkSession, log: DataFrame) -> DataFrame:
    """Writes the log as files, streams them through the projector, and returns each document's last row.

    Each micro-batch overwrites a folder of its own number, so a repeated batch changes nothing."""
    at = shared_folder(spark, "stream")
    rows = with_payload(log)
    rows.write.parquet(f"{at}/log")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/log")
    _drained(projector.project_documents(stream), "update", at, lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}"))
    out = spark.read.schema(f"aggregate_id string, {COLUMNS}").parquet(f"{at}/out").drop("batch")
    names = [c for c in out.columns if c != "aggregate_id"]
    last = out.groupBy("aggregate_id").agg(F.max_by(F.struct(*names), "version").alias("last"))
    return last.select("aggregate_id", "last.*").filter("status <> 'DELETED'")


def stream_status(spark: SparkSession, log: DataFrame) -> DataFrame:
    return stream_documents(spark, log).select("aggregate_id", "status", "version")


def stream_once(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Delivers the events twice in one stream and returns what is left after deduplication within a watermark."""
    at = shared_folder(spark, "stream")
    for _ in range(2):
        events.write.mode("append").parquet(f"{at}/log")
    stream = spark.readStream.schema(events.schema).parquet(f"{at}/log")
    projector.once(stream, "1 hour").writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{at}/out")
