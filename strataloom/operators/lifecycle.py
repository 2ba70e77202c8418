"""Commands on documents, knowledge bases and sources as tables: guards, the rows and events that a command makes, lists."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import read_model as R


def uuid_of(*parts: str | Column) -> Column:
    """A UUID that depends on the parts only, so a task that runs again makes the same; null parts count as empty."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(F.lit("8"), cut(18, 3)), cut(21, 12))


def valid_uuid(text: Column) -> Column:
    """The UUID in lower case, null where the text is none."""
    return F.when(F.lower(text).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lower(text))


def attach(files: DataFrame) -> DataFrame:
    """Documents from files (document_id, kb_id, file_name, content_type, content, ...): the base name, where the bytes are
    stored, their number and the status UPLOADED. Other columns stay."""
    name = F.coalesce(F.nullif(T.base_name(F.col("file_name")), F.lit("")), F.lit("document"))
    a = files.withColumn("file_name", name)
    a = a.withColumn("storage_path", F.concat(F.lit("kb/"), F.col("kb_id").cast("string"), F.lit("/raw/"), "document_id", F.lit("-"), "file_name"))
    return a.withColumns({"byte_size": F.octet_length("content").cast("long"), "status": F.lit("UPLOADED")})


def attach_events(attached: DataFrame) -> DataFrame:
    """The two events of each attached document, in one append: versions 1 and 2."""
    events = F.array(F.struct(F.lit(R.ATTACHED).alias("event_type"), F.lit(1).alias("event_version")), F.struct(F.lit(R.STORED).alias("event_type"), F.lit(2).alias("event_version")))
    return attached.select(F.col("document_id").alias("aggregate_id"), "kb_id", "file_name", "storage_path", "byte_size", F.explode(events).alias("e")).select("aggregate_id", "e.*", "kb_id", "file_name", "storage_path", "byte_size")


def content_type_by_suffix(file_name: Column) -> Column:
    """The type under which a document known by its name only is processed again."""
    return F.when(file_name.endswith(".docx"), "application/vnd.openxmlformats-officedocument.wordprocessingml.document").when(file_name.endswith(".pdf"), "application/pdf").otherwise("application/octet-stream")


def reprocess(requests: DataFrame, log: DataFrame, documents: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, events) of requests (kb_id, document_id) to process documents anew.

    log: aggregate_id, event_type, event_version. documents: document_id, file_name, storage_path; bases: kb_id. An
    answer has accepted and error: an unknown base or document is NOT_FOUND, a deleted document INVALID_STATE. An
    accepted document gets a further event that it is stored, which lifts a failure; one that has no log yet, but a row,
    gets the event of its attaching first.
    """
    state = log.groupBy(F.col("aggregate_id").alias("document_id")).agg(F.max("event_version").alias("last"), F.bool_or(F.col("event_type") == R.DELETED).alias("deleted"))
    a = requests.distinct().join(bases.select("kb_id").distinct().withColumn("base", F.lit(True)), "kb_id", "left").join(state, "document_id", "left")
    a = a.join(documents.select("document_id", "file_name", "storage_path").withColumn("row", F.lit(True)), "document_id", "left")
    error = F.when(F.col("base").isNull() | (F.col("last").isNull() & F.col("row").isNull()), "NOT_FOUND").when(F.coalesce("deleted", F.lit(False)), "INVALID_STATE")
    a = a.withColumn("error", error)
    answers = a.select("kb_id", "document_id", F.col("error").isNull().alias("accepted"), "error", F.when(F.col("error").isNull(), "UPLOADED").alias("status"))
    new = F.col("last").isNull()
    event = lambda kind, version: F.struct(F.lit(kind).alias("event_type"), version.cast("int").alias("event_version"))
    rows = F.when(new, F.array(event(R.ATTACHED, F.lit(1)), event(R.STORED, F.lit(2)))).otherwise(F.array(event(R.STORED, F.col("last") + 1)))
    events = a.filter("error is null").select("document_id", "storage_path", content_type_by_suffix(F.col("file_name")).alias("content_type"), F.explode(rows).alias("e"))
    return answers, events.select(F.col("document_id").alias("aggregate_id"), "e.*", "storage_path", F.when(F.col("e.event_type") == R.ATTACHED, F.col("content_type")).alias("content_type"))


def owned(rows: DataFrame, kb_id: object) -> DataFrame:
    """The rows of a knowledge base; nothing is told about others' rows."""
    return rows.filter(F.col("kb_id") == kb_id)


def create_bases(requests: DataFrame, ontologies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bases, rejected) of requests (kb_id, name, description, ontology_id, ontology_name).

    An ontology is named by id, else given in the request by name; a request with neither, or with an id that is not
    there, is rejected. A given name resolves to the template of that name, if there is one (of several the least id).
    """
    by_id = ontologies.select("ontology_id", F.lit(True).alias("known"))
    by_name = ontologies.groupBy(F.col("name").alias("ontology_name")).agg(F.min("ontology_id").alias("named_id"))
    a = requests.join(by_id, "ontology_id", "left").join(by_name, "ontology_name", "left")
    blank = F.coalesce(F.trim("name"), F.lit("")) == ""
    error = F.when(blank, "INVALID_NAME").when(F.col("ontology_id").isNotNull() & F.col("known").isNull(), "ONTOLOGY_NOT_FOUND").when(F.col("ontology_id").isNull() & (F.coalesce("ontology_name", F.lit("")) == ""), "ONTOLOGY_REQUIRED")
    a = a.withColumn("error", error)
    made = a.filter("error is null").select("kb_id", F.trim("name").alias("name"), "description", F.lit("ACTIVE").alias("status"), F.concat(F.lit("kb/"), F.col("kb_id").cast("string")).alias("storage_partition"), F.coalesce("ontology_id", "named_id").alias("ontology_id"))
    return made, a.filter("error is not null").select("kb_id", "error")


def upsert_bases(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Bases by kb_id: the incoming row holds, but an ontology stays where the incoming row names none."""
    new = incoming.withColumn("new", F.lit(1))
    a = existing.withColumn("new", F.lit(0)).unionByName(new, allowMissingColumns=True)
    rest = [c for c in existing.columns if c not in ("kb_id", "ontology_id")]
    return a.groupBy("kb_id").agg(F.max_by(F.struct(*rest), "new").alias("row"), F.max_by("ontology_id", F.when(F.col("ontology_id").isNotNull(), F.col("new"))).alias("ontology_id")).select("kb_id", *[F.col(f"row.{c}") for c in rest], "ontology_id")


# What a folder source may be set to, and the types that it takes unless told otherwise.
FOLDER_ID = r"^(root|[a-zA-Z0-9_-]+)$"
BASELINE_DAYS = 30
FOLDER_MIMES = (
    "application/pdf",
    "application/vnd.google-apps.document",
    "application/vnd.google-apps.spreadsheet",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/msword",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "text/plain",
    "text/markdown",
    "audio/mpeg",
    "audio/wav",
    "audio/x-m4a",
)
_SETTINGS = {"folder_id": str, "recursive": bool, "baseline_days": int, "include_mime_types": list}


def folder_config(text: str) -> dict:
    """The settings of a folder source from JSON, with defaults; a wrong or unknown setting is a ValueError."""
    given = json.loads(text)
    unknown = set(given) - set(_SETTINGS)
    if unknown or any(not isinstance(v, _SETTINGS[k]) for k, v in given.items()):
        raise ValueError(f"unknown or wrong settings: {sorted(unknown) or given}")
    out = {"recursive": True, "baseline_days": BASELINE_DAYS, "include_mime_types": list(FOLDER_MIMES)} | given
    out["folder_id"] = out.get("folder_id", "").strip()
    if not re.match(FOLDER_ID, out["folder_id"]) or out["baseline_days"] < 0:
        raise ValueError("folder_id must be letters, digits, - and _; baseline_days must not be negative")
    return out


def create_sources(requests: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, rejected) of requests (source_id, kb_id, name, folder_id, baseline_days)."""
    a = requests.join(bases.select("kb_id").distinct().withColumn("base", F.lit(True)), "kb_id", "left")
    folder = F.trim("folder_id")
    bad = ~F.coalesce(folder.rlike(FOLDER_ID), F.lit(False)) | (F.coalesce("baseline_days", F.lit(BASELINE_DAYS)) < 0)
    a = a.withColumn("error", F.when(F.col("base").isNull(), "NOT_FOUND").when(F.coalesce(F.trim("name"), F.lit("")) == "", "INVALID_NAME").when(bad, "INVALID_CONFIG"))
    made = a.filter("error is null").select("source_id", "kb_id", F.trim("name").alias("name"), folder.alias("folder_id"), F.coalesce("baseline_days", F.lit(BASELINE_DAYS)).alias("baseline_days"), F.lit("IDLE").alias("status"), F.lit(None).cast("string").alias("cursor"))
    return made, a.filter("error is not null").select("source_id", "error")


def without_sources(sources: DataFrame, runs: DataFrame, failures: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, their runs and failures without those of ``gone`` (source_id); documents that they brought stay."""
    keep = lambda df: df.join(gone.select("source_id").distinct(), "source_id", "left_anti")
    return keep(sources), keep(runs), keep(failures)


def list_runs(runs: DataFrame, source_id: object, limit: int = 50) -> DataFrame:
    """A source's runs, the newest first."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    return runs.filter(F.col("source_id") == source_id).orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def newest_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs of every source; each task cuts its rows to ``limit`` a source before they are shuffled."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    order = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("place")


def list_sources(sources: DataFrame, kb_id: object) -> DataFrame:
    """A knowledge base's sources, the oldest first."""
    return sources.filter(F.col("kb_id") == kb_id).orderBy("created_at", "source_id")


def list_templates(templates: DataFrame) -> DataFrame:
    """Ontology templates by name, the newest version of each first."""
    return templates.orderBy("name", F.desc("version"))


def with_documents(bases: DataFrame, documents: DataFrame, columns: list[str]) -> DataFrame:
    """Bases with ``documents``, the rows of theirs as an ordered array, empty where there are none. A base's documents meet in
    one row: for bases of a page of results; ``base_detail`` lists those of a large one."""
    nested = documents.groupBy("kb_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("documents"))
    kind = nested.schema["documents"].dataType
    return bases.join(nested, "kb_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast(kind)))


def base_summaries(bases: DataFrame, ontologies: DataFrame, documents: DataFrame) -> DataFrame:
    """Knowledge bases, the newest first, with their ontology's name and how many documents are there, indexed, failed and
    on their way; the documents' counts combine before the shuffle."""
    s = F.col("status")
    n = documents.groupBy("kb_id").agg(F.count("*").alias("documents_count"), F.count_if(s == "INDEXED").alias("indexed"), F.count_if(s == "FAILED").alias("failed"))
    o = ontologies.select("ontology_id", F.col("name").alias("ontology_name"))
    a = bases.join(o, "ontology_id", "left").join(n, "kb_id", "left").na.fill(0, ["documents_count", "indexed", "failed"])
    a = a.withColumn("processing", F.col("documents_count") - F.col("indexed") - F.col("failed"))
    return a.select("kb_id", "name", "description", "status", "created_at", "ontology_name", "documents_count", "indexed", "failed", "processing").orderBy(F.desc("created_at"), "kb_id")


def base_detail(documents: DataFrame, kb_id: object) -> DataFrame:
    """A knowledge base's documents, the oldest first."""
    return owned(documents, kb_id).orderBy("created_at", "document_id")


def archive(bases: DataFrame, documents: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bases and documents after the deletions in a log of bases: a deleted base is ARCHIVED and has no documents."""
    gone = log.filter(F.col("event_type") == "KnowledgeBaseDeleted").select(F.col("aggregate_id").alias("kb_id")).distinct()
    marked = bases.join(gone.withColumn("gone", F.lit(True)), "kb_id", "left").withColumn("status", F.when(F.col("gone"), "ARCHIVED").otherwise(F.col("status"))).drop("gone")
    return marked, documents.join(gone, "kb_id", "left_anti")


def uploads(files: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """Files (name, size) to upload: those of the endings, each (name, size) once."""
    return files.filter(T.suffix(F.col("name")).isin(*endings)).dropDuplicates(["name", "size"])


# How lists are shown as text.
def shown_base(name: Column, kb_id: Column, description: Column, status: Column, documents: Column) -> Column:
    """One knowledge base in a Markdown list."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("- **"), text(name), F.lit("** (`"), text(kb_id), F.lit("`)\n  - Descrição: "), text(description), F.lit("\n  - Status: "), text(status), F.lit("\n  - Documentos: "), text(documents))


def shown_hit(file_name: Column, title: Column, match_type: Column, doc_id: Column, preview: Column) -> Column:
    """One hit of the quick search in a Markdown list."""
    return F.concat(F.lit("- **"), file_name, F.lit("** | Seção: *"), title, F.lit("* (`"), match_type, F.lit("`)\n  - Document ID: `"), doc_id.cast("string"), F.lit("`\n  - Trecho: "), preview)


def shown_evidence(answer: Column, triples: Column) -> Column:
    """An answer with the first ten different triples of its results, in order, if there are any."""
    first = F.slice(F.array_distinct(triples), 1, 10)
    lines = F.array_join(F.transform(first, lambda t: F.concat(F.lit("  - "), t)), "\n")
    return F.when(F.size(first) > 0, F.concat(answer, F.lit("\n\n### Evidências do Grafo\n- **Relações no Grafo (Triplas)**:\n"), lines)).otherwise(answer)
