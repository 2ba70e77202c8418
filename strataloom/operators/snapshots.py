"""The read model from a snapshot and the events after it: summaries of slices of a log that merge associatively.

A summary of any slice of a document's events, in order, tells what the slice does to whatever row it meets: the last event
after which the status no longer depends on what it was, which weaker events came after that one and whether told progress
came first among them (so it is a map from status to status), the last value of each part of the row with its version, and
the run of progress at the slice's end with whether it fills the slice. Merging two summaries is one join by document; a
row is finished from the merged summary. So a read costs the snapshot and the events after it, not the whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import read_model as R

_WEAK = (R.STORED, R.PROGRESS, R.PARSED)
#: Parts of a row of which the last value holds: the events that set them, and their columns.
_PARTS = {
    "attached": ((R.ATTACHED,), ("file_name", "enable_ocr", "ocr_instructions")),
    "path": ((R.ATTACHED, R.STORED), ("storage_path",)),
    "error": ((R.FAILED,), ("step", "error_message")),
    "chunks": ((R.CHUNKED,), ("total_parents", "total_children")),
    "indexed": ((R.INDEXED,), ("nodes", "edges")),
}
COLUMNS = ["aggregate_id", "version", "deleted", "reset", "reset_kind", "stored", "progress", "parsed", "led", *_PARTS, "shown", "run"]


def _constant(index: int, kind: Column) -> Column:
    """What an event that begins a step by itself sets: 0 the step, 1 current, 2 percentage, 3 message."""
    return F.coalesce(*[F.when(kind == k, F.lit(v[index])) for k, v in R.PROGRESS_OF.items()])


def summary(log: DataFrame) -> DataFrame:
    """One row a document, COLUMNS, of a slice of its log. Folds combine before the shuffle; events are read again only of
    documents in which told progress and other weak events follow the last reset.

    An empty slice has no rows. Events without aggregate_id are no document's and are left out."""
    log = R.with_payload(log).filter("aggregate_id is not null")
    version, kind = F.col("event_version"), F.col("event_type")
    own = kind == R.PROGRESS
    tells = kind.isin(R.PROGRESS, *R.PROGRESS_OF)
    step = F.when(own, F.col("step")).otherwise(_constant(0, kind))
    is_reset = kind.isin(*R.RESETS)
    last = lambda k: F.coalesce(F.max(F.when(kind == k, version)), F.lit(0))
    part = lambda name: F.max_by(F.struct(version.alias("v"), *_PARTS[name][1]), F.when(kind.isin(*_PARTS[name][0]), version)).alias(name)
    shown = F.struct(
        version.alias("v"), step.alias("step"), F.when(own, F.col("current")).otherwise(_constant(1, kind)).alias("current"), F.when(own, F.col("total")).when(kind == R.CHUNKED, F.col("total_children")).otherwise(F.lit(1)).alias("total"),
        F.when(own, F.col("message")).otherwise(_constant(3, kind)).alias("message"), kind.alias("kind"), F.col("percentage").alias("own"),
    )
    base = log.groupBy("aggregate_id").agg(
        F.max(version).alias("version"), F.bool_or(kind == R.DELETED).alias("deleted"), last(R.STORED).alias("stored"), last(R.PROGRESS).alias("progress"), last(R.PARSED).alias("parsed"),
        F.coalesce(F.max(F.when(is_reset, version)), F.lit(0)).alias("reset"), F.max_by(kind, F.when(is_reset, version)).alias("reset_kind"), *[part(n) for n in _PARTS], F.max_by(shown, F.when(tells, version)).alias("shown"),
    )
    after = lambda c: F.col(c) > F.col("reset")
    unclear = base.filter(after("progress") & (after("stored") | after("parsed"))).select(F.col("aggregate_id").alias("of"), F.col("reset").alias("from"))
    first = log.filter(kind.isin(*_WEAK)).join(unclear, F.col("aggregate_id") == F.col("of")).filter(version > F.col("from")).groupBy("of").agg(F.min_by("event_type", "event_version").alias("first"))
    led = F.when(F.col("first").isNotNull(), F.col("first") == R.PROGRESS).when(after("progress"), True).when(after("stored") | after("parsed"), False)
    out = base.join(first, base.aggregate_id == first.of, "left").withColumn("led", led).drop("of", "first")
    # the run at the end: it began after the last told progress of another step, or with the last event that begins a step
    steps = log.filter(tells).withColumn("step", step).groupBy("aggregate_id", "step").agg(F.max(version).alias("any"), F.max(F.when(~own, version)).alias("begun"))
    ends = steps.join(base.select("aggregate_id", F.col("shown.step").alias("at")), "aggregate_id")
    same = F.col("step").eqNullSafe(F.col("at"))
    ends = ends.groupBy(F.col("aggregate_id").alias("of")).agg(F.max(F.when(same, F.col("begun")).otherwise(F.col("any"))).alias("ended"), F.max(F.when(same, F.col("begun"))).alias("begun"))
    told = log.filter(own).join(ends, F.col("aggregate_id") == F.col("of")).filter(version > F.coalesce("ended", F.lit(0))).groupBy("of").agg(F.max("percentage").alias("told"))
    out = out.join(ends, out.aggregate_id == ends.of, "left").drop("of")
    out = out.join(told, out.aggregate_id == told.of, "left").drop("of")
    constant = _constant(2, F.col("shown.kind"))
    begins = F.when(F.col("begun") == F.col("ended"), F.when(F.col("shown.step") == R.PROGRESS_OF[R.INDEXED][0], R.PROGRESS_OF[R.INDEXED][2]))
    value = F.when(F.col("shown.kind") != R.PROGRESS, constant).when(F.col("shown.step").isNull(), F.col("shown.own")).otherwise(F.greatest("told", begins))
    whole = F.col("ended").isNull() & (F.col("shown.kind") == R.PROGRESS) & F.col("shown.step").isNotNull()
    run = F.when(F.col("shown").isNotNull(), F.struct(F.col("shown.step").alias("step"), value.cast("int").alias("value"), whole.alias("whole")))
    return out.withColumns({"run": run, "shown": F.when(F.col("shown").isNotNull(), F.col("shown").dropFields("own"))}).select(*COLUMNS)


def merge(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """The summary of two slices one after the other. Associative; a document in one of them only keeps its row."""
    a, b = earlier.select(*[F.col(c).alias(f"a_{c}") for c in COLUMNS]), later.select(*[F.col(c).alias(f"b_{c}") for c in COLUMNS])
    j = a.join(b, F.col("a_aggregate_id") == F.col("b_aggregate_id"), "full")
    A, B = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    number = lambda c: F.greatest(F.coalesce(A(c), F.lit(0)), F.coalesce(B(c), F.lit(0))).alias(c)
    anew = F.coalesce(B("reset"), F.lit(0)) > 0
    goes_on = A("run").isNotNull() & F.col("b_run.whole") & (F.col("a_run.step") == F.col("b_run.step"))
    on = F.struct(F.col("b_run.step").alias("step"), F.greatest("a_run.value", "b_run.value").alias("value"), F.col("a_run.whole").alias("whole"))
    fresh = F.struct(F.col("b_run.step").alias("step"), F.col("b_run.value").alias("value"), (F.col("b_run.whole") & A("run").isNull()).alias("whole"))
    run = F.when(B("run").isNull(), A("run")).when(F.coalesce(goes_on, F.lit(False)), on).otherwise(fresh)
    return j.select(
        F.coalesce(A("aggregate_id"), B("aggregate_id")).alias("aggregate_id"), number("version"), (F.coalesce(A("deleted"), F.lit(False)) | F.coalesce(B("deleted"), F.lit(False))).alias("deleted"),
        number("reset"), F.when(anew, B("reset_kind")).otherwise(A("reset_kind")).alias("reset_kind"), number("stored"), number("progress"), number("parsed"),
        F.when(anew, B("led")).otherwise(F.coalesce(A("led"), B("led"))).alias("led"), *[F.coalesce(B(c), A(c)).alias(c) for c in (*_PARTS, "shown")], run.alias("run"),
    )


def status_after(before: Column) -> Column:
    """The status that a summary's events make of a status: the slice as a map from status to status."""
    after = lambda c: F.col(c) > F.col("reset")
    start = F.coalesce(*[F.when(F.col("reset_kind") == k, v) for k, v in R.RESETS.items()], before)
    lifted = F.when(after("parsed"), "PARSED").when(after("stored"), "UPLOADED")
    of_failed = F.when(F.col("led"), "PROCESSING").otherwise(F.coalesce(lifted, F.lit("FAILED")))
    of_uploaded = F.when(after("parsed"), "PARSED").otherwise("UPLOADED")
    moved = F.when(start == "FAILED", of_failed).when(start == "PENDING_UPLOAD", F.coalesce(lifted, start)).when(start == "UPLOADED", of_uploaded).otherwise(start)
    return F.when(F.col("deleted") | (before == "DELETED"), "DELETED").otherwise(moved)


def rows(summary_: DataFrame) -> DataFrame:
    """(aggregate_id, and the read model's columns) of the summary of logs from their beginning, without deleted documents."""
    error = F.coalesce(F.col("error.v") > F.greatest("stored", "progress"), F.lit(False))
    return summary_.filter("not deleted").select(
        "aggregate_id", status_after(F.lit("PENDING_UPLOAD")).alias("status"), "version", "attached.file_name", "path.storage_path", "attached.enable_ocr", "attached.ocr_instructions",
        F.when(error, F.col("error.step")).alias("error_step"), F.when(error, F.col("error.error_message")).alias("error_message"),
        F.col("shown.step").alias("progress_step"), F.col("shown.current").alias("progress_current"), F.col("shown.total").alias("progress_total"), F.col("run.value").alias("progress_percentage"), F.col("shown.message").alias("progress_message"),
        "chunks.total_parents", "chunks.total_children", F.col("indexed.nodes").alias("indexed_nodes"), F.col("indexed.edges").alias("indexed_edges"),
    )


# A log in slices, a folder each, and snapshots of its first ones.


def store_slices(log: DataFrame, path: str) -> None:
    """Adds events to a stored log; ``slice``, a whole number that grows with a document's versions, names their folder."""
    log.repartition("slice", "aggregate_id").write.mode("append").partitionBy("slice").parquet(path)


def _between(spark: SparkSession, log_path: str, after: int, last: int | None) -> DataFrame:
    events = spark.read.parquet(log_path).filter(F.col("slice") > after)
    return events if last is None else events.filter(F.col("slice") <= last)


def take(spark: SparkSession, log_path: str, last: int, path: str, earlier: tuple[str, int] | None = None) -> tuple[str, int]:
    """Stores the summary of slices up to ``last`` and names it (path, last); from an earlier snapshot where there is one."""
    new = summary(_between(spark, log_path, earlier[1] if earlier else -(1 << 62), last))
    (merge(spark.read.parquet(earlier[0]), new) if earlier else new).write.parquet(path)
    return path, last


def current(spark: SparkSession, log_path: str, snapshot: tuple[str, int]) -> DataFrame:
    """The read model as of now: the snapshot merged with what came after it. Only slices after the snapshot are read."""
    return rows(merge(spark.read.parquet(snapshot[0]), summary(_between(spark, log_path, snapshot[1], None))))
