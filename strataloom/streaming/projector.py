"""Streaming read models: document status with state, runs that end once, barriers, duplicates, time-outs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strataloom import importable
from strataloom.operators.read_model import COLUMNS, apply_event, step_status, with_payload

_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _plain(v):
    """A cell of a pandas frame as Python has it."""
    return None if v is None or v is pd.NA or isinstance(v, float) and v != v else v.item() if hasattr(v, "item") else v


class DocumentProjector(StatefulProcessor):
    """Keeps each document's row of the read model; an event that is not newer is a repeated delivery."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("document", COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        row = dict(zip(_NAMES, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(_NAMES) | {"version": 0}
        events = [{k: _plain(v) for k, v in e.items()} for part in rows for e in part.to_dict("records")]
        for e in sorted(events, key=lambda e: e["event_version"]):
            if e["event_version"] > row["version"]:
                row = apply_event(row, {k: int(v) if isinstance(v, float) else v for k, v in e.items()})
        self.state.update(tuple(row[c] for c in _NAMES))
        yield pd.DataFrame({"aggregate_id": [str(key[0])]} | {c: pd.Series([row[c]], dtype=object) for c in _NAMES})

    def close(self) -> None:
        pass


def project_documents(events: DataFrame) -> DataFrame:
    """A stream of (aggregate_id, and the read model's columns), a row for each document that a micro-batch changed.

    A deleted document's row has the status DELETED."""
    importable(events.sparkSession)
    return with_payload(events).groupBy("aggregate_id").transformWithStateInPandas(DocumentProjector(), f"aggregate_id string, {COLUMNS}", "Update", "None")


class RunProjector(StatefulProcessor):
    """Counts a run's documents, each by its last word, and tells the run's end once; then it forgets the documents.

    Counters make a row cost the same however many documents a run has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.outcomes = handle.getMapState("outcomes", "document_id string", "outcome string, seq long")
        self.counts = handle.getValueState("counts", "total int, indexed int, failed int")
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ended = self.ended.exists()
        total, good, bad = self.counts.get() if self.counts.exists() else (0, 0, 0)
        for part in rows:
            total = max(total, int(part["total_files"].max()))
            for document, outcome, seq in zip(part["document_id"], part["outcome"], part["seq"], strict=True):
                if ended or document is None:
                    continue
                before, at = self.outcomes.getValue((document,)) if self.outcomes.containsKey((document,)) else (None, -1)
                seq = at if pd.isna(seq) else int(seq)  # without seq the last to arrive holds
                if seq < at:
                    continue
                good += (outcome == "indexed") - (before == "indexed")
                bad += (outcome == "failed") - (before == "failed")
                self.outcomes.updateValue((document,), (outcome, seq))
        if ended:
            return
        if good + bad < total:
            self.counts.update((total, good, bad))
            return
        self.ended.update((True,))
        self.outcomes.clear()
        self.counts.clear()
        status = "COMPLETED" if not bad else "PARTIALLY_FAILED" if good else "FAILED"
        yield pd.DataFrame({"run_id": [str(key[0])], "status": [status], "indexed_files": [good], "failed_files": [bad]})

    def close(self) -> None:
        pass


def project_runs(outcomes: DataFrame) -> DataFrame:
    """A stream of ended runs from (run_id, document_id, outcome, total_files), and seq, the order of a document's outcomes, where
    there is one; rows without a run are ignored."""
    importable(outcomes.sparkSession)
    seq = F.col("seq").cast("long") if "seq" in outcomes.columns else F.lit(None).cast("long")
    rows = outcomes.filter("run_id is not null").select("run_id", "document_id", "outcome", "total_files", seq.alias("seq"))
    return rows.groupBy("run_id").transformWithStateInPandas(RunProjector(), "run_id string, status string, indexed_files int, failed_files int", "Append", "None")


class Watchdog(StatefulProcessor):
    """Tells of documents of which nothing was heard for ``idle_ms`` while in a middle status."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status = self.state.get()[0] if self.state.exists() else None
        newest = 0
        for part in rows:
            for e in part.sort_values("event_version").itertuples():
                status = step_status(status, e.event_type)
                newest = max(newest, int(e.occurred_at.timestamp() * 1000))
        self.state.update((status,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status in ("UPLOADED", "PARSED", "CHUNKED"):
            self.handle.registerTimer(newest + self.idle_ms)
        yield pd.DataFrame({"aggregate_id": pd.Series(dtype=str), "status": pd.Series(dtype=str)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"aggregate_id": [str(key[0])], "status": [self.state.get()[0]]})

    def close(self) -> None:
        pass


class Barrier(StatefulProcessor):
    """Tells once that all tasks of a document's step are done, each counted once; forgets a step ``keep_ms`` after its
    last task."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getMapState("tasks", "task_id string", "seen boolean")
        self.released = handle.getValueState("released", "released boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, newest = 0, 0
        for part in rows:
            total = max(total, int(part["total"].max()))
            newest = max(newest, int(part["occurred_at"].max().timestamp() * 1000))
            for t in part["task_id"].dropna().unique():
                self.tasks.updateValue((str(t),), (True,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(newest + self.keep_ms)
        done = sum(1 for _ in self.tasks.keys())
        if done >= total and not self.released.exists():
            self.released.update((True,))
            yield pd.DataFrame({"document_id": [str(key[0])], "step": [str(key[1])], "completed": [done]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tasks.clear()
        self.released.clear()
        return iter(())

    def close(self) -> None:
        pass


def released_steps(tasks: DataFrame, keep_hours: int = 24, late: str = "1 hour") -> DataFrame:
    """A stream of (document_id, step, completed), once for each step whose tasks are all done, from (document_id, step,
    task_id, total, occurred_at). A total of 0 is done at once; a step is forgotten when nothing was heard of it for so long.
    Tasks that come later than ``late`` after newer ones are not counted."""
    importable(tasks.sparkSession)
    timed = tasks.withWatermark("occurred_at", late)
    return timed.groupBy("document_id", "step").transformWithStateInPandas(Barrier(keep_hours * 3_600_000), "document_id string, step string, completed int", "Append", "EventTime")


def swap_stream(indexed: DataFrame, remove, checkpoint: str):
    """Starts the stream of indexed documents (document_id, replaces_doc_id): ``remove(gone, batch_id)`` gets the distinct
    replaced doc_ids of each micro-batch. Removing twice changes nothing, so a repeated batch is harmless."""

    def each(batch: DataFrame, number: int) -> None:
        remove(batch.filter("replaces_doc_id is not null and replaces_doc_id <> document_id").select(F.col("replaces_doc_id").alias("doc_id")).distinct(), number)

    return indexed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def stuck_documents(events: DataFrame, idle_minutes: int = 10) -> DataFrame:
    importable(events.sparkSession)
    timed = events.withWatermark("occurred_at", "0 seconds")
    return timed.groupBy("aggregate_id").transformWithStateInPandas(Watchdog(idle_minutes * 60_000), "aggregate_id string, status string", "Append", "EventTime")


def once(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """The stream without repeated deliveries of an event_id, as long as they come within so long."""
    return events.withWatermark("occurred_at", within).dropDuplicatesWithinWatermark(["event_id"])


def fan_out(stream: DataFrame, handlers: list, checkpoint: str):
    """Starts the stream; each micro-batch goes to every handler (batch, id), the batch computed once."""

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for h in handlers:
                h(kept, number)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def publish(rows: DataFrame) -> DataFrame:
    """Tasks as queue messages: one JSON text each."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("value"))


def consume(messages: DataFrame, schema: str) -> DataFrame:
    """The messages that can be read; others are dropped."""
    return messages.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("m"), F.try_parse_json("value").isNotNull().alias("ok")).filter("ok").select("m.*")
