"""The read model of documents, folded from their log: status, errors, progress and counts, one row a document.

All folds are aggregates whose parts combine before the shuffle. Only where an order of events inside a document decides
are that document's events looked at again, joined with what the first fold found.

A log has aggregate_id, event_type, event_version and the payload's columns, of which missing ones count as null:
file_name, storage_path, enable_ocr, ocr_instructions (attached, stored); step, error_message (failed); step, current,
total, percentage, message (progress); total_parents, total_children (chunked); nodes, edges (indexed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTACHED, STORED, PROGRESS, PARSED = "DocumentAttached", "DocumentStored", "DocumentProgressUpdated", "DocumentParsedToMarkdown"
CHUNKED, EXTRACTED, INDEXED = "DocumentChunked", "GraphExtractedFromDocument", "DocumentKnowledgeIndexed"
FAILED, DELETED = "DocumentProcessingFailed", "DocumentDeleted"

#: Events after which the status no longer depends on what it was. Attaching again changes no status.
RESETS = {CHUNKED: "CHUNKED", EXTRACTED: "GRAPH_EXTRACTED", INDEXED: "INDEXED", FAILED: "FAILED"}
#: Events that lift a status, and from what to what. Others stay.
LIFTS = {
    STORED: {"PENDING_UPLOAD": "UPLOADED", "FAILED": "UPLOADED"},
    PROGRESS: {"FAILED": "PROCESSING"},
    PARSED: {"PENDING_UPLOAD": "PARSED", "UPLOADED": "PARSED", "FAILED": "PARSED"},
}

# The progress that an event begins: step, current, percentage, message. The total is 1, of CHUNKED the children.
PROGRESS_OF = {
    PARSED: ("CHUNKING", 0, 0, "Fatiando documento em Chunks Hierárquicos (Pai/Filho)..."),
    CHUNKED: ("EMBEDDINGS", 0, 0, "Iniciando geração de representações vetoriais..."),
    EXTRACTED: ("INDEXING", 0, 0, "Indexando nós e arestas no FalkorDB..."),
    INDEXED: ("INDEXED", 1, 100, "Processamento e indexação concluídos com sucesso"),
}

PAYLOAD = {
    "file_name": "string", "storage_path": "string", "enable_ocr": "boolean", "ocr_instructions": "string", "step": "string", "error_message": "string",
    "current": "int", "total": "int", "percentage": "int", "message": "string", "total_parents": "int", "total_children": "int", "nodes": "int", "edges": "int",
}
COLUMNS = (
    "status string, version int, file_name string, storage_path string, enable_ocr boolean, ocr_instructions string, error_step string, error_message string, "
    "progress_step string, progress_current int, progress_total int, progress_percentage int, progress_message string, "
    "total_parents int, total_children int, indexed_nodes int, indexed_edges int"
)


def with_payload(log: DataFrame) -> DataFrame:
    have = log.columns
    payload = [(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in PAYLOAD.items()]
    return log.select("aggregate_id", "event_type", F.col("event_version").cast("int").alias("event_version"), *payload)


def _by_kind(values: dict[str, object], kind: Column, other: Column) -> Column:
    out = other
    for k, v in values.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def _base(log: DataFrame, extra: list[Column]) -> DataFrame:
    """One row for each document that isn't deleted: the last reset, the last of each weaker event, and ``extra``."""
    version, kind = F.col("event_version"), F.col("event_type")
    last = lambda k: F.coalesce(F.max(F.when(kind == k, version)), F.lit(0))
    is_reset = kind.isin(*RESETS)
    return log.groupBy("aggregate_id").agg(
        F.max(F.when(kind == DELETED, version)).alias("deleted"), F.max(version).alias("version"),
        F.coalesce(F.max(F.when(is_reset, version)), F.lit(0)).alias("reset"), F.max_by(kind, F.when(is_reset, version)).alias("reset_kind"),
        last(STORED).alias("stored"), last(PROGRESS).alias("progress"), last(PARSED).alias("parsed"), *extra,
    ).filter("deleted is null").drop("deleted")


def _with_status(base: DataFrame, log: DataFrame) -> DataFrame:
    """Adds status. After a failure, the first of storing, parsing and progress decides whether parsing still lifts:
    only for documents with both kinds after it are their events read again."""
    after = lambda c: F.col(c) > F.col("reset")
    failed = F.coalesce(F.col("reset_kind") == FAILED, F.lit(False))
    unclear = base.filter(failed & after("progress") & (after("stored") | after("parsed"))).select(F.col("aggregate_id").alias("of"), "reset")
    weak = log.filter(F.col("event_type").isin(STORED, PROGRESS, PARSED)).join(unclear, F.col("aggregate_id") == F.col("of")).filter("event_version > reset")
    first = weak.groupBy("of").agg(F.min_by("event_type", "event_version").alias("first"))
    lifted = F.when(after("parsed"), "PARSED").when(after("stored"), "UPLOADED")
    of_failed = F.when(F.coalesce(F.col("first"), F.lit(PROGRESS)).eqNullSafe(PROGRESS) & after("progress"), "PROCESSING").otherwise(F.coalesce(lifted, F.lit("FAILED")))
    status = F.when(F.col("reset_kind").isNull(), F.coalesce(lifted, F.lit("PENDING_UPLOAD"))).when(failed, of_failed).otherwise(_by_kind(RESETS, F.col("reset_kind"), F.lit(None)))
    return base.join(first, base["aggregate_id"] == first["of"], "left").drop("of").withColumn("status", status)


def document_status(log: DataFrame) -> DataFrame:
    """(aggregate_id, status, last_version) of every document whose log doesn't end its life."""
    return _with_status(_base(log, []), log).select("aggregate_id", "status", F.col("version").alias("last_version"))


def documents(log: DataFrame) -> DataFrame:
    """(aggregate_id, and COLUMNS) of every document whose log doesn't end its life.

    An error is shown until a later event stores the document or tells progress. The progress shown is that of the
    last event that begins or tells one; within a run of told progress of one step the percentage never falls.
    """
    log = with_payload(log)
    version, kind = F.col("event_version"), F.col("event_type")
    tells = kind.isin(PROGRESS, *PROGRESS_OF)
    own = kind == PROGRESS
    step = F.when(own, F.col("step")).otherwise(_by_kind({k: v[0] for k, v in PROGRESS_OF.items()}, kind, F.lit(None)))
    shown = F.struct(
        step.alias("step"), F.when(own, F.col("current")).otherwise(_by_kind({k: v[1] for k, v in PROGRESS_OF.items()}, kind, F.lit(None))).alias("current"),
        F.when(own, F.col("total")).when(kind == CHUNKED, F.col("total_children")).otherwise(F.lit(1)).alias("total"),
        F.when(own, F.col("message")).otherwise(_by_kind({k: v[3] for k, v in PROGRESS_OF.items()}, kind, F.lit(None))).alias("message"), kind.alias("kind"),
    )
    newest = lambda value, *kinds: F.max_by(value, F.when(kind.isin(*kinds), version))
    of = lambda *names: F.struct(*names)
    base = _base(log, [
        newest(of("file_name", "enable_ocr", "ocr_instructions"), ATTACHED).alias("attached"), newest(F.col("storage_path"), ATTACHED, STORED).alias("storage_path"),
        newest(of("step", "error_message", "event_version"), FAILED).alias("error"), F.max_by(shown, F.when(tells, version)).alias("shown"),
        newest(of("total_parents", "total_children"), CHUNKED).alias("chunks"), newest(of("nodes", "edges"), INDEXED).alias("indexed"),
    ])
    a = _with_status(base, log)
    # the run of told progress that goes on at the end: it began after the last event of another step or kind
    steps = log.filter(tells).withColumn("step", step).groupBy("aggregate_id", "step").agg(F.max(version).alias("any"), F.max(F.when(~own, version)).alias("begun"))
    last = steps.groupBy("aggregate_id").agg(F.max(F.struct("any", "step")).alias("l"))
    ends = steps.join(last, "aggregate_id").groupBy("aggregate_id").agg(F.max(F.when(F.col("step").eqNullSafe(F.col("l.step")), F.col("begun")).otherwise(F.col("any"))).alias("ended"))
    told = log.filter(own).join(ends, "aggregate_id").filter(version > F.coalesce("ended", F.lit(0))).groupBy(F.col("aggregate_id").alias("of")).agg(F.max("percentage").alias("told"))
    a = a.join(told, a["aggregate_id"] == told["of"], "left")
    error = F.col("error.event_version") > F.greatest("stored", "progress")
    percentage = F.when(F.col("shown.kind") == PROGRESS, F.col("told")).otherwise(_by_kind({k: v[2] for k, v in PROGRESS_OF.items()}, F.col("shown.kind"), F.lit(None)))
    return a.select(
        "aggregate_id", "status", "version", "attached.file_name", "storage_path", "attached.enable_ocr", "attached.ocr_instructions",
        F.when(error, F.col("error.step")).alias("error_step"), F.when(error, F.col("error.error_message")).alias("error_message"),
        F.col("shown.step").alias("progress_step"), F.col("shown.current").alias("progress_current"), F.col("shown.total").alias("progress_total"),
        percentage.cast("int").alias("progress_percentage"), F.col("shown.message").alias("progress_message"),
        "chunks.total_parents", "chunks.total_children", F.col("indexed.nodes").alias("indexed_nodes"), F.col("indexed.edges").alias("indexed_edges"),
    )


def step_status(status: str | None, event_type: str) -> str | None:
    """The status after an event; DELETED is final, and a document begins as PENDING_UPLOAD."""
    if status == "DELETED" or event_type == DELETED:
        return "DELETED"
    status = status or "PENDING_UPLOAD"
    return RESETS.get(event_type) or LIFTS.get(event_type, {}).get(status, status)


def apply_event(row: dict, e: dict) -> dict:
    """One document's row after an event: the streaming form of ``documents``, and what tests hold the folds against."""
    kind, row = e["event_type"], dict(row)
    row["status"], row["version"] = step_status(row.get("status"), kind), e["event_version"]
    if kind == ATTACHED:
        row |= {c: e[c] for c in ("file_name", "storage_path", "enable_ocr", "ocr_instructions")}
    elif kind == STORED:
        row |= {"storage_path": e["storage_path"], "error_step": None, "error_message": None}
    elif kind == FAILED:
        row |= {"error_step": e["step"], "error_message": e["error_message"]}
    elif kind == PROGRESS:
        same = row.get("progress_step") is not None and row["progress_step"] == e["step"]
        told = max(row.get("progress_percentage") or 0, e["percentage"]) if same else e["percentage"]
        row |= {"error_step": None, "error_message": None, "progress_step": e["step"], "progress_current": e["current"], "progress_total": e["total"], "progress_percentage": told, "progress_message": e["message"]}
    if kind in PROGRESS_OF:
        step, current, percentage, message = PROGRESS_OF[kind]
        row |= {"progress_step": step, "progress_current": current, "progress_total": e["total_children"] if kind == CHUNKED else 1, "progress_percentage": percentage, "progress_message": message}
    if kind == CHUNKED:
        row |= {"total_parents": e["total_parents"], "total_children": e["total_children"]}
    elif kind == INDEXED:
        row |= {"indexed_nodes": e["nodes"], "indexed_edges": e["edges"]}
    return row
