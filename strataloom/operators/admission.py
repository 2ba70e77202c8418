"""One limit for all workers: when each call of a batch may start, so that no span of time exceeds requests or tokens.

A call takes a share of a window, the greater of its shares of the requests and of the tokens. Calls are laid end to end in
order, by sums over partitions and the partitions' totals, and the line is stretched by the largest share among them: then
the calls that start within any span as long as a window, not only those of one window, never take more than a whole. A
call that takes over half a window would stretch all others, so such calls come after them, a window each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom import importable, storage

_PLACED = "call_id long, seq long, cost long, part int, before long"


def _end_to_end(calls: DataFrame, order: list[str], folder: str) -> tuple[DataFrame, int]:
    """(calls with ``at``, the cost of all calls before, and the cost of all). Only a row a partition meets in one place."""
    ordered = calls.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = held + np.cumsum(batch.column("cost").to_numpy())
            before = np.concatenate(([held], sums[:-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, dtype=np.int32)), pa.array(before)], [x.split()[0] for x in _PLACED.split(", ")])
            held = int(sums[-1]) if batch.num_rows else held

    placed = storage.stored(ordered.mapInArrow(run, _PLACED), folder)
    totals = placed.groupBy("part").agg(F.sum("cost").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    whole = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    return placed.join(F.broadcast(bases), "part").select("call_id", "seq", "cost", (F.col("base") + F.col("before")).alias("at")), whole


def plan(calls: DataFrame, requests: int, tokens: int, window_ms: int = 60_000) -> DataFrame:
    """(call_id, start_ms, window) of calls (call_id, seq, tokens), in the order of seq, then call_id.

    In any ``window_ms`` at most ``requests`` calls start, with at most ``tokens`` tokens together; a call of more tokens counts
    as the limit, one of none or null as 1. ``window`` numbers the windows from the beginning on: calls of one can be sent
    together by whoever keeps their starts. A plan takes less than twice the windows that any plan needs, one more and
    those of the large calls. Sums are of whole numbers, so the plan doesn't depend on partitions."""
    if requests < 1 or tokens < 1:
        raise ValueError("limits must be positive")
    spark = calls.sparkSession
    importable(spark)
    at = storage.shared_folder(spark, "admission")
    need = F.least(F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(1)), F.lit(1)), F.lit(tokens))
    # a window has requests * tokens units
    rows = calls.select(F.col("call_id").cast("long").alias("call_id"), F.col("seq").cast("long").alias("seq"), F.greatest(need * requests, F.lit(tokens)).cast("long").alias("cost"))
    unit = requests * tokens
    small, large = rows.filter(F.col("cost") * 2 <= unit), rows.filter(F.col("cost") * 2 > unit)
    widest = small.agg(F.max("cost")).first()[0] or 0
    span = unit - widest
    laid, whole = _end_to_end(small, ["seq", "call_id"], f"{at}/small")
    start = lambda c: F.floor(c.cast("decimal(38,0)") * window_ms / F.lit(span)).cast("long")
    first = laid.select("call_id", F.ceil(F.col("at").cast("decimal(38,0)") * window_ms / F.lit(span)).cast("long").alias("start_ms"))
    ends = spark.range(1).select(start(F.lit(whole))).first()[0] + window_ms if whole else 0
    alone, _ = _end_to_end(large.withColumn("cost", F.lit(1).cast("long")), ["seq", "call_id"], f"{at}/large")
    second = alone.select("call_id", (F.col("at") * window_ms + ends).alias("start_ms"))
    return first.unionByName(second).withColumn("window", F.floor(F.col("start_ms") / window_ms))
