"""Event-sourced state: appending with a version check, folding a log into read models, cleaning up after deletion.

A log has event_id, aggregate_id, event_type, event_version, occurred_at and the payload's columns. Folds are
written as aggregates whose parts combine before the shuffle, so a long history costs one row a task and aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.read_model import DELETED, document_status  # noqa: F401  the status is part of a log's folds

STALE = ("UPLOADED", "PARSED", "CHUNKED")


def number_events(batch: DataFrame, log: DataFrame) -> DataFrame:
    """The batch (aggregate_id, seq, ...) with event_version continuing each aggregate's log."""
    last = log.groupBy("aggregate_id").agg(F.max("event_version").alias("base"))
    order = Window.partitionBy("aggregate_id").orderBy("seq")
    return batch.join(last, "aggregate_id", "left").withColumn("event_version", (F.coalesce("base", F.lit(0)) + F.row_number().over(order)).cast("int")).drop("base")


def check_versions(commands: DataFrame, log: DataFrame) -> DataFrame:
    """Commands (aggregate_id, expected_version) with actual_version and conflict."""
    last = log.groupBy("aggregate_id").agg(F.max("event_version").alias("actual"))
    out = commands.join(last, "aggregate_id", "left").withColumn("actual_version", F.coalesce("actual", F.lit(0)).cast("int")).drop("actual")
    return out.withColumn("conflict", F.col("expected_version") != F.col("actual_version"))


def append(batch: DataFrame, log: DataFrame) -> DataFrame:
    """The batch without rows whose (aggregate_id, event_version) the log has already."""
    return batch.join(log.select("aggregate_id", "event_version"), ["aggregate_id", "event_version"], "left_anti")


def fold_latest(log: DataFrame, fields: list[str]) -> DataFrame:
    """Each aggregate's last value of each field that isn't null, with its number of events."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("event_version"))).alias(f) for f in fields]
    return log.groupBy("aggregate_id").agg(F.count("*").alias("n_events"), *last)


def progress(updates: DataFrame) -> DataFrame:
    """(document_id, version, step, percentage) with ``shown``: within a run of one step, never less than before."""
    order = Window.partitionBy("document_id").orderBy("version")
    a = updates.withColumn("fresh", (~F.col("step").eqNullSafe(F.lag("step").over(order))).cast("int"))
    a = a.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("document_id", "run").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    return a.withColumn("shown", F.max("percentage").over(inside)).drop("fresh", "run")


def percentage(current: Column, total: Column, done: Column) -> Column:
    """Whole percent, at most 99 until done."""
    raw = F.when(total > 0, F.floor(current * 100 / total)).otherwise(0).cast("int")
    return F.when(done, F.lit(100)).otherwise(F.least(raw, F.lit(99)))


def drop_after_delete(log: DataFrame) -> DataFrame:
    """The log without events that follow an aggregate's deletion: commands on it do nothing."""
    gone = log.filter(F.col("event_type") == DELETED).groupBy("aggregate_id").agg(F.min("event_version").alias("end"))
    return log.join(gone, "aggregate_id", "left").filter("end is null or event_version <= end").drop("end")


def cascade_delete(children: DataFrame, parents_gone: DataFrame, key: str) -> DataFrame:
    return children.join(parents_gone.select(key), key, "left_anti")


def stale_documents(documents: DataFrame, now: Column, minutes: int = 10, most_attempts: int = 3, limit: int = 50) -> DataFrame:
    """Documents stuck in a middle status for longer than so many minutes, oldest first; RECOVERING is looked at too."""
    old = F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes))
    return documents.filter(F.col("status").isin(*STALE, "RECOVERING") & old & (F.col("recovery_attempt") < most_attempts)).orderBy("updated_at", "id").limit(limit)


def recover(documents: DataFrame, stale: DataFrame, most_attempts: int = 3) -> DataFrame:
    """Compare and set: stale documents whose attempt is still the one seen become RECOVERING, or FAILED at the last."""
    seen = stale.select("id", F.col("recovery_attempt").alias("seen"))
    a = documents.join(seen, "id", "left")
    won = F.col("seen").eqNullSafe(F.col("recovery_attempt")) & F.col("seen").isNotNull()
    status = F.when(won & (F.col("recovery_attempt") + 1 >= most_attempts), "FAILED").when(won, "RECOVERING").otherwise(F.col("status"))
    return a.withColumns({"status": status, "recovery_attempt": F.col("recovery_attempt") + won.cast("int")}).drop("seen")
