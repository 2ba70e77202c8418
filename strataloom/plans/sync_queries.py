"""Queries of the whole read model, of syncs and retries, and of the commands on documents and bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import discovery, lifecycle, read_model, snapshots, sync
from strataloom.plans import data as D
from strataloom.plans.event_queries import SQL_SOURCES
from strataloom.plans.registry import query
from strataloom.storage import shared_folder
from strataloom.streaming import native

# The whole read model: a walk over each document's events in SQL, folds and a stream here.
_BEGIN = {"DocumentParsedToMarkdown": "CHUNKING", "DocumentChunked": "EMBEDDINGS", "GraphExtractedFromDocument": "INDEXING", "DocumentKnowledgeIndexed": "INDEXED"}
_KIND = """CASE event_type WHEN 'view' THEN CASE WHEN value > 50 THEN 'DocumentStored' ELSE 'DocumentProgressUpdated' END
 WHEN 'click' THEN CASE WHEN value > 60 THEN 'DocumentParsedToMarkdown' WHEN value > 30 THEN 'DocumentChunked' ELSE 'GraphExtractedFromDocument' END
 WHEN 'error' THEN CASE WHEN value > 95 THEN 'DocumentDeleted' ELSE 'DocumentProcessingFailed' END WHEN 'signup' THEN 'DocumentAttached' ELSE 'DocumentKnowledgeIndexed' END"""
READ_MODEL = f"""WITH RECURSIVE l AS (SELECT user_id AS id, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v, (props->>'$.k')::INT AS k, floor(value)::INT AS pct, CASE WHEN (props->>'$.k')::INT < 4 THEN 'CHUNKING' WHEN (props->>'$.k')::INT < 7 THEN 'OCR' ELSE 'INDEXING' END AS s FROM events),
w AS (SELECT DISTINCT id, 0::BIGINT AS v, 'PENDING_UPLOAD' AS status, NULL::VARCHAR AS file_name, NULL::VARCHAR AS storage_path, NULL::BOOLEAN AS enable_ocr, NULL::VARCHAR AS error_step, NULL::VARCHAR AS error_message, NULL::VARCHAR AS progress_step, NULL::INT AS progress_current, NULL::INT AS progress_total, NULL::INT AS progress_percentage,
  NULL::INT AS total_parents, NULL::INT AS total_children, NULL::INT AS indexed_nodes, NULL::INT AS indexed_edges FROM l
 UNION ALL SELECT l.id, l.v,
  CASE WHEN w.status = 'DELETED' OR l.kind = 'DocumentDeleted' THEN 'DELETED' WHEN l.kind = 'DocumentChunked' THEN 'CHUNKED' WHEN l.kind = 'GraphExtractedFromDocument' THEN 'GRAPH_EXTRACTED' WHEN l.kind = 'DocumentKnowledgeIndexed' THEN 'INDEXED' WHEN l.kind = 'DocumentProcessingFailed' THEN 'FAILED'
   WHEN l.kind = 'DocumentStored' AND w.status IN ('PENDING_UPLOAD', 'FAILED') THEN 'UPLOADED' WHEN l.kind = 'DocumentProgressUpdated' AND w.status = 'FAILED' THEN 'PROCESSING' WHEN l.kind = 'DocumentParsedToMarkdown' AND w.status IN ('PENDING_UPLOAD', 'UPLOADED', 'FAILED') THEN 'PARSED' ELSE w.status END,
  CASE WHEN l.kind = 'DocumentAttached' THEN 'f' || l.k ELSE w.file_name END, CASE WHEN l.kind IN ('DocumentAttached', 'DocumentStored') THEN 'p' || l.v ELSE w.storage_path END, CASE WHEN l.kind = 'DocumentAttached' THEN l.k > 5 ELSE w.enable_ocr END,
  CASE WHEN l.kind = 'DocumentProcessingFailed' THEN l.s WHEN l.kind IN ('DocumentStored', 'DocumentProgressUpdated') THEN NULL ELSE w.error_step END, CASE WHEN l.kind = 'DocumentProcessingFailed' THEN 'e' || l.k WHEN l.kind IN ('DocumentStored', 'DocumentProgressUpdated') THEN NULL ELSE w.error_message END,
  CASE l.kind WHEN 'DocumentProgressUpdated' THEN l.s {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _BEGIN.items())} ELSE w.progress_step END,
  CASE WHEN l.kind = 'DocumentProgressUpdated' THEN l.k WHEN l.kind = 'DocumentKnowledgeIndexed' THEN 1 WHEN l.kind IN ('DocumentParsedToMarkdown', 'DocumentChunked', 'GraphExtractedFromDocument') THEN 0 ELSE w.progress_current END,
  CASE WHEN l.kind = 'DocumentProgressUpdated' THEN 10 WHEN l.kind = 'DocumentChunked' THEN 3 * l.k WHEN l.kind IN ('DocumentParsedToMarkdown', 'GraphExtractedFromDocument', 'DocumentKnowledgeIndexed') THEN 1 ELSE w.progress_total END,
  CASE WHEN l.kind = 'DocumentProgressUpdated' THEN CASE WHEN w.progress_step = l.s THEN greatest(coalesce(w.progress_percentage, 0), l.pct) ELSE l.pct END WHEN l.kind = 'DocumentKnowledgeIndexed' THEN 100 WHEN l.kind IN ('DocumentParsedToMarkdown', 'DocumentChunked', 'GraphExtractedFromDocument') THEN 0 ELSE w.progress_percentage END,
  CASE WHEN l.kind = 'DocumentChunked' THEN l.k ELSE w.total_parents END, CASE WHEN l.kind = 'DocumentChunked' THEN 3 * l.k ELSE w.total_children END, CASE WHEN l.kind = 'DocumentKnowledgeIndexed' THEN l.k + 1 ELSE w.indexed_nodes END, CASE WHEN l.kind = 'DocumentKnowledgeIndexed' THEN l.k + 2 ELSE w.indexed_edges END
 FROM w JOIN l ON l.id = w.id AND l.v = w.v + 1),
ends AS (SELECT id, max(v) AS v FROM l GROUP BY 1)
SELECT id AS aggregate_id, v AS version, w.* EXCLUDE (id, v) FROM w JOIN ends USING (id, v) WHERE status <> 'DELETED'"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.drop("ocr_instructions", "progress_message").withColumns({"aggregate_id": F.col("aggregate_id").cast("long"), "version": F.col("version").cast("long")})


@query(READ_MODEL)
def read_model_fold(spark, d):
    """Every document's row of the read model."""
    return _shown(read_model.documents(D.whole_log(spark, d)))


@query(READ_MODEL)
def stream_projection(spark, d):
    """The same rows by a stream over the log, run until all is read."""
    return _shown(native.stream_documents(spark, D.whole_log(spark, d)))


@query(READ_MODEL)
def read_model_incremental(spark, d):
    """The same rows from a snapshot that was taken twice, the second time from the first one, and the events after it."""
    at = shared_folder(spark, "log")
    snapshots.store_slices(D.whole_log(spark, d).withColumn("slice", F.floor(F.col("event_version") / 17).cast("int")), f"{at}/log")
    first = snapshots.take(spark, f"{at}/log", 0, f"{at}/first")
    second = snapshots.take(spark, f"{at}/log", 2, f"{at}/second", first)
    return _shown(snapshots.current(spark, f"{at}/log", second))


# Syncs: nations are sources in the knowledge bases of their regions, customers what they hold.
_SQL_SYNC = """sources AS (SELECT n_nationkey AS source_id, n_regionkey AS kb_id, CASE n_nationkey WHEN 3 THEN 'DISABLED' WHEN 7 THEN 'SYNCING' ELSE 'IDLE' END AS status, 'c' || n_nationkey AS cursor FROM nation),
accepted AS (SELECT *, 'r' || source_id AS run_id FROM sources WHERE status = 'IDLE' AND source_id <> 5),
items AS (SELECT a.*, c_custkey, c_name, c_acctbal, c_mktsegment FROM accepted a JOIN customer ON c_nationkey = source_id),
documents AS (SELECT n_regionkey AS kb_id, c_custkey AS external_id, c_name AS file_name, CASE WHEN c_acctbal > 3000 THEN c_mktsegment ELSE 'old' END AS version_hash, CASE WHEN c_mktsegment = 'BUILDING' THEN 'FAILED' ELSE 'INDEXED' END AS status FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0),
judged AS (SELECT i.*, CASE WHEN d.external_id IS NOT NULL THEN 'skipped' WHEN c_acctbal > 9000 THEN 'File ''folder/' || c_name || ''' exceeds maximum allowed size (60000000 > 52428800 bytes)' WHEN c_acctbal < -500 THEN 'no content of ''folder/' || c_name || '''' ELSE 'attached' END AS outcome
  FROM items i LEFT JOIN documents d ON d.kb_id = i.kb_id AND d.external_id = c_custkey AND d.status = 'INDEXED' AND d.version_hash = c_mktsegment),
counts AS (SELECT a.run_id, a.source_id, a.cursor, count(c_custkey) AS total_files, count(*) FILTER (WHERE outcome = 'skipped') AS indexed_files, count(*) FILTER (WHERE outcome NOT IN ('skipped', 'attached')) AS failed_files FROM accepted a LEFT JOIN judged j ON j.run_id = a.run_id GROUP BY 1, 2, 3)"""
_SQL_STATUS = "CASE WHEN total_files = 0 THEN 'COMPLETED' WHEN indexed_files + failed_files < total_files THEN 'INGESTING' WHEN failed_files = 0 THEN 'COMPLETED' WHEN indexed_files > 0 THEN 'PARTIALLY_FAILED' ELSE 'FAILED' END"


def _sources(spark, d) -> DataFrame:
    key = F.col("n_nationkey")
    status = F.when(key == 3, "DISABLED").when(key == 7, "SYNCING").otherwise("IDLE")
    return D.table(spark, d, "nation").select(key.alias("source_id"), F.col("n_regionkey").alias("kb_id"), status.alias("status"), F.concat(F.lit("c"), key.cast("string")).alias("cursor"), F.lit(None).cast("string").alias("pending_cursor"))


def _requests(spark, d) -> DataFrame:
    """A request for every source, one of them in a wrong knowledge base, and one for a source that is not there."""
    s = _sources(spark, d).select("source_id", F.when(F.col("source_id") == 5, 99).otherwise(F.col("kb_id")).alias("kb_id"))
    return s.unionByName(spark.createDataFrame([(99, None)], "source_id int, kb_id int")).withColumn("run_id", F.concat(F.lit("r"), F.col("source_id").cast("string")))


def _sync(spark, d, again: bool = False) -> dict[str, DataFrame]:
    """A sync of customers; ``again``: of the same listing, once what the first one attached is there."""
    c = D.table(spark, d, "customer")
    regions = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("kb_id"))
    balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    found = c.select(F.col("c_nationkey").alias("source_id"), F.col("c_custkey").alias("external_id"), F.concat(F.lit("folder/"), "c_name").alias("name"), F.lit("text/plain").alias("mime_type"), segment.alias("version_hash"), F.when(balance > 9000, 60_000_000).otherwise(1000).alias("size_bytes"))
    documents = c.filter(balance > 0).join(regions, "c_nationkey").select("kb_id", F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("file_name"), F.col("c_custkey").alias("external_id"), F.when(balance > 3000, segment).otherwise("old").alias("version_hash"), F.when(segment == "BUILDING", "FAILED").otherwise("INDEXED").alias("status"), F.col("c_custkey").alias("ord"))
    contents = c.filter(balance >= -500).select(F.col("c_custkey").cast("string").alias("external_id"), F.encode("c_name", "utf-8").alias("content"))
    cursors = _sources(spark, d).select("source_id", F.concat(F.lit("n"), F.col("source_id").cast("string")).alias("next_cursor"))
    gone = D.table(spark, d, "supplier").select(F.col("s_nationkey").alias("source_id"), F.col("s_suppkey").alias("external_id"))
    run = lambda sources, docs: sync.sync_sources(_requests(spark, d), sources, found, cursors, docs, lambda items: discovery.loaded(items, contents), deleted=gone)
    first = run(_sources(spark, d), documents)
    if not again:
        return first
    made = first["attached"].select("kb_id", F.col("document_id").alias("doc_id"), "file_name", "external_id", "version_hash", "status", F.lit(1 << 40).alias("ord"))
    kept = documents.withColumns({"doc_id": F.col("doc_id").cast("string"), "external_id": F.col("external_id").cast("string"), "ord": F.col("ord").cast("long")})
    idle = _sources(spark, d).join(first["sources"].select("source_id"), "source_id", "left_anti").withColumn("pending_run_id", F.lit(None).cast("string"))
    return run(first["sources"].unionByName(idle), kept.unionByName(made))


@query(f"""WITH {_SQL_SYNC} SELECT run_id, total_files, indexed_files, failed_files, {_SQL_STATUS} AS status, CASE WHEN failed_files = 0 THEN 'n' || source_id ELSE cursor END AS cursor, CASE WHEN failed_files > 0 THEN 'n' || source_id END AS pending_cursor, NULL AS error FROM counts
UNION ALL SELECT 'r' || source_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN source_id = 5 THEN 'DATA_SOURCE_NOT_FOUND' WHEN status = 'DISABLED' THEN 'DATA_SOURCE_DISABLED' ELSE 'DATA_SOURCE_ALREADY_SYNCING' END FROM sources WHERE status <> 'IDLE' OR source_id = 5
UNION ALL SELECT 'r99', NULL, NULL, NULL, NULL, NULL, NULL, 'DATA_SOURCE_NOT_FOUND'""")
def sync_run(spark, d):
    """What a sync of all sources does to runs and cursors, and what it refuses."""
    t = _sync(spark, d)
    r = t["runs"].join(t["sources"].select("source_id", "cursor", "pending_cursor"), "source_id").select("run_id", "total_files", "indexed_files", "failed_files", "status", "cursor", "pending_cursor", F.lit(None).cast("string").alias("error"))
    return r.unionByName(t["rejected"].select("run_id", "error"), allowMissingColumns=True)


@query(f"""WITH {_SQL_SYNC} SELECT run_id, c_custkey AS external_id, outcome AS error, NULL AS file_name, NULL AS replaces_doc_id, NULL AS byte_size FROM judged WHERE outcome NOT IN ('skipped', 'attached')
UNION ALL SELECT run_id, c_custkey, NULL, c_name, e.id, length(c_name) FROM judged LEFT JOIN (SELECT kb_id, file_name, max(external_id) AS id FROM documents GROUP BY 1, 2) e ON e.kb_id = judged.kb_id AND e.file_name = c_name WHERE outcome = 'attached'
UNION ALL SELECT NULL, external_id, 'removed', NULL, NULL, NULL FROM documents WHERE (kb_id, external_id) IN (SELECT (a.kb_id, s_suppkey) FROM supplier JOIN accepted a ON a.source_id = s_nationkey)""")
def sync_items(spark, d):
    """What a sync attaches, with what that replaces, what it can't load, and what it removes."""
    t = _sync(spark, d)
    key = F.col("external_id").cast("long").alias("external_id")
    a = t["attached"].select("run_id", key, "file_name", F.col("replaces_doc_id").cast("long").alias("replaces_doc_id"), "byte_size")
    a = t["failures"].select("run_id", key, "error").unionByName(a, allowMissingColumns=True)
    return a.unionByName(t["removed"].select(F.col("doc_id").alias("external_id"), F.lit("removed").alias("error")), allowMissingColumns=True)


@query(f"""WITH {_SQL_SYNC} SELECT run_id, total_files, total_files - failed_files AS indexed_files, failed_files, 0 AS attached, CASE WHEN total_files = 0 OR failed_files = 0 THEN 'COMPLETED' WHEN failed_files < total_files THEN 'PARTIALLY_FAILED' ELSE 'FAILED' END AS status FROM counts""")
def sync_twice(spark, d):
    """The same listing a second time: nothing is loaded but what failed, which fails again."""
    t = _sync(spark, d, again=True)
    n = t["attached"].groupBy("run_id").agg(F.count("*").alias("attached"))
    return t["runs"].join(n, "run_id", "left").select("run_id", "total_files", "indexed_files", "failed_files", F.coalesce("attached", F.lit(0)).alias("attached"), "status")


@query(f"""WITH sources AS (SELECT n_nationkey AS source_id, CASE WHEN n_nationkey = 7 THEN 'SYNCING' WHEN n_nationkey % 4 = 0 THEN 'FAILED' ELSE 'IDLE' END AS status FROM nation), accepted AS (SELECT * FROM sources WHERE status <> 'SYNCING' AND source_id <> 5),
f AS (SELECT c_nationkey AS source_id, CASE WHEN c_acctbal < -500 THEN CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END WHEN c_acctbal < -200 THEN CASE WHEN c_mktsegment <> 'MACHINERY' THEN 1 ELSE 0 END ELSE 0 END AS ok FROM customer WHERE c_nationkey % 5 <> 1 AND c_acctbal < 0 AND (c_nationkey < 20 OR c_acctbal < -200 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))),
t AS (SELECT c_nationkey AS source_id, count(*) AS total_files, count(*) FILTER (WHERE c_acctbal >= 0) AS good FROM customer GROUP BY 1),
g AS (SELECT source_id, count(*) AS bad, sum(ok)::BIGINT AS fixed FROM f GROUP BY 1),
n AS (SELECT a.source_id, coalesce(total_files, 0) AS total_files, coalesce(fixed, 0) AS reprocessed_count, coalesce(good, 0) + coalesce(fixed, 0) AS indexed_files, coalesce(bad - fixed, 0) AS failed_files, coalesce(bad, 0) AS bad, coalesce(bad > 0 AND bad = fixed AND source_id % 3 <> 0, false) AS promoted, a.status AS before FROM accepted a LEFT JOIN t USING (source_id) LEFT JOIN g USING (source_id))
SELECT 'r' || source_id AS run_id, total_files, indexed_files, failed_files, reprocessed_count, {_SQL_STATUS} AS status, CASE WHEN promoted THEN 'n' || source_id ELSE 'c' || source_id END AS cursor, CASE WHEN NOT promoted THEN 'n' || source_id END AS pending_cursor, CASE WHEN bad > 0 THEN 'IDLE' ELSE before END AS source_status FROM n""")
def retry_run(spark, d):
    """A retry of every run's failures: what was stored is processed anew, what wasn't is loaded anew, the rest stays. Some
    runs have no failures, and some cursors were left pending by another run: those stay as they are."""
    c = D.table(spark, d, "customer")
    balance, segment, key = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    run = F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("run_id")
    bad = c.filter((F.col("c_nationkey") % 5 != 1) & (balance < 0) & ((F.col("c_nationkey") < 20) | ((balance < -200) & ~segment.isin("BUILDING", "MACHINERY"))))
    failures = bad.select(run, F.col("c_nationkey").alias("source_id"), F.when(balance < -500, key).alias("doc_id"), F.col("c_name").alias("file_name"), F.lit("e").alias("error"), F.when(balance < -200, key).alias("external_id"), F.lit("text/plain").alias("mime_type"), segment.alias("version_hash"), F.lit(1).cast("long").alias("size_bytes"))
    n = c.groupBy("c_nationkey").agg(F.count("*").alias("total_files"), F.count_if(balance >= 0).alias("indexed_files"))
    sources = _sources(spark, d).withColumns({"pending_cursor": F.concat(F.lit("n"), F.col("source_id").cast("string")), "status": F.when(F.col("status") == "SYNCING", "SYNCING").when(F.col("source_id") % 4 == 0, "FAILED").otherwise("IDLE"), "pending_run_id": F.when(F.col("source_id") % 3 == 0, "older").otherwise(F.concat(F.lit("r"), F.col("source_id").cast("string")))})
    runs = sources.join(n, F.col("source_id") == F.col("c_nationkey"), "left").na.fill(0, ["total_files", "indexed_files"]).select(F.concat(F.lit("r"), F.col("source_id").cast("string")).alias("run_id"), "source_id", "total_files", "indexed_files")
    contents = c.filter(segment != "MACHINERY").select(key.alias("external_id"), F.encode("c_name", "utf-8").alias("content"))
    reprocessed = c.select(key.alias("document_id"), (segment != "BUILDING").alias("accepted"))
    t = sync.retry_failed(_requests(spark, d), sources, runs, failures, reprocessed, lambda items: discovery.loaded(items.withColumn("name", F.col("file_name")), contents))
    return t["runs"].join(t["sources"].select("source_id", "cursor", "pending_cursor", F.col("status").alias("source_status")), "source_id").select("run_id", "total_files", "indexed_files", "failed_files", "reprocessed_count", "status", "cursor", "pending_cursor", "source_status")


@query(f"""WITH l AS (SELECT user_id AS id, count(*) AS last, bool_or({_KIND} = 'DocumentDeleted') AS deleted FROM events GROUP BY 1), a AS (SELECT n_nationkey AS kb_id, c_custkey AS document_id, l.last, l.deleted, CASE WHEN n_regionkey = 1 OR (l.last IS NULL AND c_acctbal <= 0) THEN 'NOT_FOUND' WHEN l.deleted THEN 'INVALID_STATE' END AS error FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN l ON l.id = c_custkey)
SELECT document_id, error, NULL AS event_type, NULL AS event_version FROM a UNION ALL SELECT document_id, NULL, 'DocumentStored', CASE WHEN last IS NULL THEN 2 ELSE last + 1 END FROM a WHERE error IS NULL UNION ALL SELECT document_id, NULL, 'DocumentAttached', 1 FROM a WHERE error IS NULL AND last IS NULL""")
def reprocess(spark, d):
    """Answers to requests to process customers' documents anew, and the events of those accepted."""
    c, n = D.table(spark, d, "customer"), D.table(spark, d, "nation")
    requests = c.select(F.col("c_nationkey").alias("kb_id"), F.col("c_custkey").alias("document_id"))
    documents = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"), F.concat("c_name", F.lit(".pdf")).alias("file_name"), F.lit("p").alias("storage_path"))
    answers, events = lifecycle.reprocess(requests, D.whole_log(spark, d), documents, n.filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("kb_id")))
    e = events.select(F.col("aggregate_id").alias("document_id"), "event_type", F.col("event_version").cast("long").alias("event_version"))
    return answers.select("document_id", "error").unionByName(e, allowMissingColumns=True)


@query(f"WITH RECURSIVE {SQL_SOURCES} SELECT source_id, seq, error FROM w WHERE error IS NOT NULL")
def rejected_starts(spark, d):
    kind = F.when(F.col("event_type") == "signup", "enabled").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "started").when(F.col("event_type") == "purchase", "disabled").otherwise("completed")
    return sync.rejected_starts(D.table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), kind.alias("kind")))


@query("""SELECT n_nationkey AS kb_id, n_name AS name, r_name AS ontology_name, count(c_custkey) AS documents_count, count(c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING') AS indexed, count(c_custkey) FILTER (WHERE c_mktsegment = 'MACHINERY') AS failed, count(c_custkey) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS processing
FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def base_summaries(spark, d):
    n = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("kb_id"), F.col("n_name").alias("name"), F.lit("").alias("description"), F.lit("ACTIVE").alias("status"), F.col("n_nationkey").alias("created_at"), F.col("n_regionkey").alias("ontology_id"))
    o = D.table(spark, d, "region").select(F.col("r_regionkey").alias("ontology_id"), F.col("r_name").alias("name"))
    docs = D.table(spark, d, "customer").select(F.col("c_nationkey").alias("kb_id"), F.when(F.col("c_mktsegment") == "BUILDING", "INDEXED").when(F.col("c_mktsegment") == "MACHINERY", "FAILED").otherwise("PARSED").alias("status"))
    return lifecycle.base_summaries(n, o, docs).select("kb_id", "name", "ontology_name", "documents_count", "indexed", "failed", "processing")


@query("""WITH RECURSIVE f AS (SELECT o_orderkey AS id, o_custkey AS parent, o_orderdate AS day, o_orderpriority AS p FROM orders),
folders AS (SELECT c_custkey AS id, c_custkey // 4 AS parent FROM customer), r AS (SELECT 1 AS id UNION SELECT folders.id FROM r JOIN folders ON folders.parent = r.id)
SELECT id AS external_id, CASE WHEN p LIKE '1%' THEN 'm' || id WHEN p LIKE '2%' THEN 'v' || id ELSE epoch(day)::BIGINT::VARCHAR END AS version_hash FROM f WHERE parent IN (SELECT id FROM r) AND p NOT LIKE '5%' AND day >= TIMESTAMP '1998-08-02' - INTERVAL 900 DAY""")
def folder_baseline(spark, d):
    """The items of a folder source: a walk over folders, types asked for, none too old."""
    o, c = D.table(spark, d, "orders"), D.table(spark, d, "customer")
    p, key = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    files = o.select(
        key.alias("file_id"), F.col("o_custkey").cast("string").alias("parent_id"), F.concat(F.lit("f"), key).alias("name"), F.when(p.startswith("5"), "image/png").otherwise("text/plain").alias("mime_type"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_time"), F.when(p.startswith("1"), F.concat(F.lit("m"), key)).alias("md5"), F.when(p.startswith("2"), F.concat(F.lit("v"), key)).alias("version"),
    )
    folders = c.select(F.col("c_custkey").cast("string").alias("file_id"), F.floor(F.col("c_custkey") / 4).cast("string").alias("parent_id"), F.lit(discovery.FOLDER).alias("mime_type"))
    now = F.lit("1998-08-02").cast("timestamp")
    found = discovery.baseline(files.unionByName(folders, allowMissingColumns=True), "1", shared_folder(spark, "walks"), ["text/plain"], 900, now)
    return found.select(F.col("external_id").cast("long").alias("external_id"), "version_hash")
