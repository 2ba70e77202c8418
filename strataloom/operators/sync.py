"""Data sources: what a sync discovers, skips, replaces and remembers, and how its runs are counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import lifecycle

MOST_BYTES = 50 * 1024 * 1024

# Why a request is refused.
NOT_FOUND, DISABLED, SYNCING = "DATA_SOURCE_NOT_FOUND", "DATA_SOURCE_DISABLED", "DATA_SOURCE_ALREADY_SYNCING"
DISABLED_STATE = "DISABLED"
#: Statuses of documents that a discovered item of the same version doesn't load again.
PRESENT = ("INDEXED", "INGESTING", "UPLOADED", "CHUNKED", "PARSED")


def gate(discovered: DataFrame, existing: DataFrame, allowed: tuple[str, ...] = ("INDEXED", "PROCESSING", "UPLOADED", "PARSED", "CHUNKED", "GRAPH_EXTRACTED")) -> DataFrame:
    """Discovered items that no document in an allowed status has with the same version."""
    known = existing.filter(F.col("status").isin(*allowed)).select("external_id", "version_hash")
    return discovered.join(known, ["external_id", "version_hash"], "left_anti")


def by_size(items: DataFrame, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Items to load, and rows for the dead letters about those too large."""
    large = F.coalesce(F.col("size_bytes") > most, F.lit(False))
    error = F.concat(F.lit("file exceeds "), F.lit(most // (1024 * 1024)).cast("string"), F.lit(" MiB"))
    return items.filter(~large), items.filter(large).withColumn("error", error)


def replaces(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Items with replaces_doc_id: the last document (by ord) of the same file name."""
    last = documents.groupBy("file_name").agg(F.max_by("doc_id", "ord").alias("replaces_doc_id"))
    return items.join(last, "file_name", "left")


def swap(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents without those that an indexed successor replaces."""
    return documents.join(indexed.filter("replaces_doc_id is not null").select(F.col("replaces_doc_id").alias("doc_id")), "doc_id", "left_anti")


def run_accounting(outcomes: DataFrame) -> DataFrame:
    """(run_id, total_files, indexed_files, failed_files, status) from (run_id, document_id, outcome, total_files).

    A document counts once, its last word by ``seq``: repeated deliveries change nothing. An empty run is complete.
    """
    last = outcomes.filter("document_id is not null").groupBy("run_id", "document_id").agg(F.max_by("outcome", "seq").alias("outcome"))
    counts = last.groupBy("run_id").agg(F.count_if(F.col("outcome") == "indexed").alias("indexed_files"), F.count_if(F.col("outcome") == "failed").alias("failed_files"))
    totals = outcomes.groupBy("run_id").agg(F.max("total_files").alias("total_files"))
    a = totals.join(counts, "run_id", "left").na.fill(0, ["indexed_files", "failed_files"])
    done = F.col("indexed_files") + F.col("failed_files") >= F.col("total_files")
    status = F.when(F.col("total_files") == 0, "COMPLETED").when(~done, "RUNNING").when(F.col("failed_files") == 0, "COMPLETED").when(F.col("indexed_files") == 0, "FAILED").otherwise("PARTIALLY_FAILED")
    return a.withColumn("status", status)


def next_cursor(runs: DataFrame) -> DataFrame:
    """(source_id, cursor, pending_cursor) after runs (source_id, seq, new_cursor, failed): a failure keeps the cursor
    and leaves the new one pending; success advances. A later success promotes what is pending by its own cursor."""
    good = F.when(F.col("failed") == 0, F.col("seq"))
    a = runs.groupBy("source_id").agg(F.max_by("new_cursor", good).alias("cursor"), F.max(good).alias("good_at"), F.max(F.when(F.col("failed") > 0, F.col("seq"))).alias("bad_at"), F.max_by("new_cursor", F.when(F.col("failed") > 0, F.col("seq"))).alias("bad"))
    return a.select("source_id", "cursor", F.when(F.col("bad_at") > F.coalesce("good_at", F.lit(-1)), F.col("bad")).alias("pending_cursor"))


def retry_routes(dead: DataFrame) -> DataFrame:
    """Dead letters with a route: a known document is processed anew, a known external file is loaded anew, others stay."""
    route = F.when(F.coalesce("doc_id", F.lit("")) != "", "reprocess").when(F.coalesce("external_id", F.lit("")) != "", "download").otherwise("unrecoverable")
    return dead.withColumn("route", route)


def reconcile(persisted: DataFrame, seen: DataFrame, key: str = "external_id") -> DataFrame:
    """Persisted failures and those seen in the run that are not among them."""
    return persisted.unionByName(seen.join(persisted.select(key), key, "left_anti"))


def barrier(tasks: DataFrame) -> DataFrame:
    """(document_id, step, completed, total, released) from (document_id, step, task_id, total): distinct tasks count."""
    a = tasks.groupBy("document_id", "step").agg(F.count_distinct("task_id").alias("completed"), F.max("total").alias("total"))
    return a.withColumn("released", F.col("completed") >= F.col("total"))


#: What a source's events make of it, whatever it was; a start counts only where none is going on and nothing forbids it.
SOURCE_STATES = {"completed": "IDLE", "failed": "FAILED", "disabled": DISABLED_STATE, "enabled": "IDLE"}


def _settled(kind: Column) -> Column:
    """The state after an event other than a start."""
    return F.coalesce(*[F.when(kind == k, v) for k, v in SOURCE_STATES.items()])


def source_status(events: DataFrame) -> DataFrame:
    """(source_id, status): IDLE, SYNCING, FAILED or DISABLED after events (source_id, seq, kind).

    Every event but ``started`` tells the state by itself: an enabled source is idle, whatever went on before. So the
    last of these and whether a start came after it decide; a start while disabled, or while a sync goes on, is refused
    and told by ``rejected_starts``. Both are found by aggregations that combine before the shuffle.
    """
    other = F.col("kind") != "started"
    a = events.groupBy("source_id").agg(F.max_by("kind", F.when(other, F.col("seq"))).alias("kind"), F.max(F.when(other, F.col("seq"))).alias("at"), F.max(F.when(~other, F.col("seq"))).alias("started_at"))
    state = F.coalesce(_settled(F.col("kind")), F.lit("IDLE"))
    going = F.coalesce(F.col("started_at") > F.col("at"), F.col("started_at").isNotNull() & F.col("at").isNull()) & (state != DISABLED_STATE)
    return a.select("source_id", F.when(going, "SYNCING").otherwise(state).alias("status"))


def rejected_starts(events: DataFrame) -> DataFrame:
    """(source_id, seq, error) of the starts that a source refuses: it is disabled, or a sync is going on already.

    The same states as ``source_status``, before each event; a source's events meet in order."""
    order = Window.partitionBy("source_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    state = _settled(F.last(F.when(F.col("kind") != "started", F.col("kind")), ignorenulls=True).over(before))
    # after an event that isn't a start nothing goes on; after a start something does, unless the source is disabled
    error = F.when(F.coalesce(state == DISABLED_STATE, F.lit(False)), DISABLED).when(F.coalesce(F.lag("kind").over(order) == "started", F.lit(False)), SYNCING)
    return events.withColumn("error", error).filter((F.col("kind") == "started") & F.col("error").isNotNull()).select("source_id", "seq", "error")


def usage_in_window(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """Calls (caller, at_seconds, tokens) with the requests and tokens of the last so many seconds, the call included."""
    span = Window.partitionBy("caller").orderBy("at_seconds").rangeBetween(-(seconds - 1), 0)
    return calls.withColumns({"requests": F.count("*").over(span), "tokens_used": F.sum("tokens").over(span)})


def guarded(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests (source_id, kb_id, run_id) with their source's columns and ``error``, why it is refused, or null.

    A request without kb_id fits a source of any knowledge base."""
    pending_run = F.col("pending_run_id") if "pending_run_id" in sources.columns else F.lit(None).cast("string")
    s = sources.select("source_id", F.col("kb_id").alias("own_kb"), "status", "cursor", "pending_cursor", pending_run.alias("pending_run_id"), F.lit(True).alias("found"))
    a = requests.join(s, "source_id", "left")
    lost = F.col("found").isNull() | F.coalesce(F.col("kb_id") != F.col("own_kb"), F.lit(False))
    error = F.when(lost, NOT_FOUND).when(F.col("status") == "DISABLED", DISABLED).when(F.col("status") == "SYNCING", SYNCING)
    return a.select("source_id", F.coalesce("kb_id", "own_kb").alias("kb_id"), "run_id", "status", "cursor", "pending_cursor", "pending_run_id", error.alias("error"))


_DLQ = ("run_id", "source_id", "doc_id", "file_name", "error", "external_id", "mime_type", "version_hash", "size_bytes")


def _counted(runs: DataFrame, skipped: DataFrame, failures: DataFrame) -> DataFrame:
    """Runs with indexed_files, failed_files and status."""
    n = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    a = runs.join(n(skipped, "indexed_files"), "run_id", "left").join(n(failures, "failed_files"), "run_id", "left").na.fill(0, ["total_files", "indexed_files", "failed_files"])
    return a.withColumn("status", run_status(F.col("total_files"), F.col("indexed_files"), F.col("failed_files")))


def run_status(total: Column, indexed: Column, failed: Column) -> Column:
    """INGESTING until every file is indexed or failed; a run without files is complete."""
    done = indexed + failed >= total
    return F.when(total == 0, "COMPLETED").when(~done, "INGESTING").when(failed == 0, "COMPLETED").when(indexed > 0, "PARTIALLY_FAILED").otherwise("FAILED")


def sync_sources(
    requests: DataFrame, sources: DataFrame, discovered: DataFrame, cursors: DataFrame, documents: DataFrame, load: Callable[[DataFrame], DataFrame],
    deleted: DataFrame | None = None, most_bytes: int = MOST_BYTES,
) -> dict[str, DataFrame]:
    """One sync of every requested source, of any number of sources and items at once.

    requests: source_id, kb_id (may be null), run_id. sources: source_id, kb_id, status, cursor, pending_cursor and
    pending_run_id, the run that left it pending.
    discovered: source_id, external_id, name, mime_type, version_hash, size_bytes; an item once. cursors: source_id,
    next_cursor. documents: kb_id, doc_id, file_name, external_id, version_hash, status, ord (age). ``load`` adds content,
    loaded_mime, loaded_hash and error to items, content null where it failed. deleted: source_id, external_id.

    Returns tables: rejected (requests with error), attached (documents made, with what they replace), events, failures
    (for a later retry), runs, sources (the new rows), removed (doc_ids of what the source deleted). An item whose
    document is there in the same version counts as indexed and isn't loaded: ``version_hash``, which the listing tells,
    is stored as it is, and ``content_hash``, that of what was loaded, beside it. A run that failed in part keeps its
    source's cursor and leaves the new one pending.
    """
    a = guarded(requests, sources)
    rejected, accepted = a.filter("error is not null"), a.filter("error is null").drop("error", "status")
    items = discovered.join(accepted.select("source_id", "kb_id", "run_id"), "source_id").withColumn("file_name", _safe_name(F.col("name")))
    present = documents.filter(F.col("status").isin(*PRESENT) & F.col("external_id").isNotNull()).groupBy("kb_id", F.col("external_id").cast("string").alias("external_id")).agg(F.max_by("version_hash", "ord").alias("known_hash"))
    by_name = documents.filter("file_name is not null").groupBy("kb_id", "file_name").agg(F.max_by("doc_id", "ord").alias("replaces_doc_id"))
    items = items.withColumn("external_id", F.col("external_id").cast("string")).join(present, ["kb_id", "external_id"], "left")
    same = F.coalesce(F.col("known_hash") == F.col("version_hash"), F.lit(False))
    skipped, work = items.filter(same), items.filter(~same).drop("known_hash")
    large = F.coalesce(F.col("size_bytes") > most_bytes, F.lit(False))
    too_large = work.filter(large).withColumn("error", F.concat(F.lit("File '"), "name", F.lit("' exceeds maximum allowed size ("), F.col("size_bytes").cast("string"), F.lit(f" > {most_bytes} bytes)")))
    loaded = load(work.filter(~large))
    loaded = loaded.withColumn("error", F.when(F.col("content").isNull(), F.coalesce("error", F.concat(F.lit("empty content of '"), "file_name", F.lit("'")))))
    failures = too_large.unionByName(loaded.filter("error is not null"), allowMissingColumns=True)
    failures = failures.withColumn("doc_id", F.lit(None).cast("string")).select(*_DLQ)
    good = loaded.filter("error is null").join(by_name, ["kb_id", "file_name"], "left")
    attached = lifecycle.attach(good.select(
        lifecycle.uuid_of("run_id", "external_id").alias("document_id"), "kb_id", "file_name", F.coalesce("loaded_mime", "mime_type").alias("content_type"), "content",
        "source_id", "run_id", "external_id", "version_hash", F.col("loaded_hash").alias("content_hash"), F.col("replaces_doc_id").cast("string").alias("replaces_doc_id"),
    ))
    totals = items.groupBy("run_id").agg(F.count("*").alias("total_files"))
    runs = _counted(accepted.select("run_id", "source_id", "kb_id").join(totals, "run_id", "left"), skipped, failures)
    after = accepted.join(cursors, "source_id", "left").join(runs.select("run_id", "failed_files", "total_files"), "run_id")
    clean = F.col("failed_files") == 0
    after = after.select(
        "source_id", "kb_id", F.lit("IDLE").alias("status"), F.when(clean, F.coalesce("next_cursor", "cursor")).otherwise(F.col("cursor")).alias("cursor"),
        F.when(~clean, F.coalesce("next_cursor", "pending_cursor")).alias("pending_cursor"),
        F.when(~clean, F.when(F.col("next_cursor").isNotNull(), F.col("run_id")).otherwise(F.col("pending_run_id"))).alias("pending_run_id"), "run_id", "total_files",
    )
    started = accepted.select(F.col("source_id").alias("aggregate_id"), F.lit("DataSourceSyncStarted").alias("event_type"), "run_id", F.lit(None).cast("long").alias("synced_files"), F.lit(None).cast("string").alias("new_cursor"))
    ended = after.select(F.col("source_id").alias("aggregate_id"), F.lit("DataSourceSyncCompleted").alias("event_type"), "run_id", F.col("total_files").alias("synced_files"), "cursor")
    gone = documents.limit(0).select("doc_id") if deleted is None else documents.withColumn("external_id", F.col("external_id").cast("string")).join(deleted.join(accepted.select("source_id", "kb_id"), "source_id").select("kb_id", F.col("external_id").cast("string").alias("external_id")).distinct(), ["kb_id", "external_id"], "left_semi").select("doc_id")
    return {
        "rejected": rejected.select("source_id", "run_id", "error"), "attached": attached, "failures": failures, "runs": runs,
        "sources": after.drop("run_id", "total_files"), "events": started.union(ended), "removed": gone,
    }


def _safe_name(name: Column) -> Column:
    return F.coalesce(F.nullif(T.base_name(name), F.lit("")), name)


def retry_failed(requests: DataFrame, sources: DataFrame, runs: DataFrame, failures: DataFrame, reprocessed: DataFrame, load: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Retries the failures of runs (requests: source_id, kb_id, run_id).

    A failure with a doc_id is done when ``reprocessed`` (document_id, accepted) accepts it; one with an external_id is
    loaded and attached anew; one with neither stays. A run whose failures are all gone promotes its source's pending
    cursor if it is the run that left it pending (``pending_run_id``): another run's failures lie behind that cursor. A run
    without failures changes nothing, its source's status included. Returns rejected, attached, failures (those left),
    runs, sources.
    """
    a = guarded(requests, sources)
    own = runs.select("run_id", F.col("source_id").alias("run_source"), "total_files", "indexed_files")
    a = a.join(own, "run_id", "left")
    error = F.when(F.col("error") == SYNCING, "CONCURRENCY_CONFLICT").when((F.col("error") == NOT_FOUND) | ~F.col("run_source").eqNullSafe(F.col("source_id")), "NOT_FOUND")
    a = a.withColumn("error", error)
    accepted = a.filter("error is null").drop("error")
    work = retry_routes(failures.join(accepted.select("run_id", "kb_id"), "run_id"))
    ok = reprocessed.filter("accepted").select(F.col("document_id").cast("string").alias("doc_id")).distinct()
    again = work.filter("route = 'reprocess'").join(ok, "doc_id", "left_semi")
    loaded = load(work.filter("route = 'download'").drop("error"))
    good = loaded.filter("content is not null")
    attached = lifecycle.attach(good.select(
        lifecycle.uuid_of("run_id", "external_id", F.lit("retry")).alias("document_id"), "kb_id", "file_name", F.coalesce("loaded_mime", "mime_type").alias("content_type"), "content",
        "source_id", "run_id", "external_id", "version_hash", F.col("loaded_hash").alias("content_hash"), F.lit(None).cast("string").alias("replaces_doc_id"),
    ))
    keys = ["run_id", "doc_id", "external_id"]
    safe = lambda df: df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys])
    solved = safe(again).unionByName(safe(good)).distinct().withColumn("solved", F.lit(True))
    marked = work.withColumns({f"_{k}": F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys}).join(solved.select(*[F.col(k).alias(f"_{k}") for k in keys], "solved"), [f"_{k}" for k in keys], "left")
    left = marked.filter("solved is null").select(*_DLQ)
    n = marked.groupBy("run_id").agg(F.count_if(F.col("solved")).alias("reprocessed_count"), F.count_if(F.col("solved").isNull()).alias("failed_files"))
    done = accepted.join(n, "run_id", "left").na.fill(0, ["reprocessed_count", "failed_files"]).withColumn("indexed_files", F.col("indexed_files") + F.col("reprocessed_count"))
    done = done.withColumn("run_status", run_status(F.col("total_files"), F.col("indexed_files"), F.col("failed_files")))
    promoted = (F.col("failed_files") == 0) & (F.col("reprocessed_count") > 0) & F.coalesce(F.col("pending_run_id") == F.col("run_id"), F.lit(False))
    retried = F.col("reprocessed_count") + F.col("failed_files") > 0
    # a source may be asked for by several runs at once; it has one row, and one of them at most promotes
    sources_ = done.groupBy("source_id", "kb_id").agg(
        F.when(F.bool_or(retried), "IDLE").otherwise(F.first("status")).alias("status"), F.coalesce(F.max(F.when(promoted, F.coalesce("pending_cursor", "cursor"))), F.first("cursor")).alias("cursor"),
        F.when(~F.bool_or(promoted), F.first("pending_cursor")).alias("pending_cursor"), F.when(~F.bool_or(promoted), F.first("pending_run_id")).alias("pending_run_id"),
    )
    runs_ = done.select("run_id", "source_id", "kb_id", "total_files", "indexed_files", "failed_files", "reprocessed_count", F.col("run_status").alias("status"))
    return {"rejected": a.filter("error is not null").select("source_id", "run_id", "error"), "attached": attached, "failures": left, "runs": runs_, "sources": sources_}
