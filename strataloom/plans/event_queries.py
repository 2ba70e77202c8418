"""Queries of event logs, read models, runs and data sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import admission, discovery, lifecycle, sync
from strataloom.operators import events as E
from strataloom.plans import data as D
from strataloom.plans.registry import query
from strataloom.sources import commits, event_store
from strataloom.storage import shared_folder
from strataloom.streaming import native


@query(f"WITH {D.SQL_LOG} SELECT event_id, aggregate_id, event_version::BIGINT AS event_version FROM log")
def event_versioning(spark, d):
    return D.log(spark, d).select("event_id", "aggregate_id", F.col("event_version").cast("long").alias("event_version"))


@query("""WITH o AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, (min(epoch_us(ts)) OVER (PARTITION BY user_id) + max(epoch_us(ts)) OVER (PARTITION BY user_id)) // 2 AS middle FROM events)
SELECT event_id, user_id AS aggregate_id, n::BIGINT AS event_version FROM o WHERE us > middle""")
def event_append_numbering(spark, d):
    """Each aggregate's events of the later half of its time, as a batch that is appended to the earlier half."""
    at, whole = F.unix_micros(F.col("ts").cast("timestamp")), Window.partitionBy("aggregate_id")
    log = D.log(spark, d).withColumn("late", at > F.shiftright(F.min(at).over(whole) + F.max(at).over(whole), 1))
    batch = log.filter("late").select("event_id", "aggregate_id", F.struct("ts", "event_id").alias("seq"))
    return E.number_events(batch, log.filter("not late")).select("event_id", "aggregate_id", F.col("event_version").cast("long").alias("event_version"))


@query(f"""WITH {D.SQL_LOG}, last AS (SELECT aggregate_id, max(event_version) AS actual FROM log WHERE event_type <> 'DocumentStored' GROUP BY 1), c AS (SELECT aggregate_id, max(event_version) AS expected FROM log GROUP BY 1)
SELECT aggregate_id, expected::BIGINT AS expected_version, coalesce(actual, 0)::BIGINT AS actual_version, expected <> coalesce(actual, 0) AS conflict FROM c LEFT JOIN last USING (aggregate_id)""")
def version_conflict(spark, d):
    log = D.log(spark, d)
    commands = log.groupBy("aggregate_id").agg(F.max("event_version").alias("expected_version"))
    r = E.check_versions(commands, log.filter("event_type <> 'DocumentStored'"))
    return r.select("aggregate_id", F.col("expected_version").cast("long").alias("expected_version"), F.col("actual_version").cast("long").alias("actual_version"), "conflict")


@query(f"""WITH {D.SQL_LOG} SELECT aggregate_id, count(*) AS n_events, arg_max(value, event_version) FILTER (WHERE value > 50) AS big_value, arg_max(props, event_version) FILTER (WHERE event_type = 'DocumentParsedToMarkdown') AS parsed_props FROM log GROUP BY 1""")
def event_fold_latest(spark, d):
    log = D.log(spark, d).withColumns({"big_value": F.when(F.col("value") > 50, F.col("value")), "parsed_props": F.when(F.col("event_type") == "DocumentParsedToMarkdown", F.col("props"))})
    return E.fold_latest(log, ["big_value", "parsed_props"])


@query(f"""WITH {D.SQL_LOG} SELECT aggregate_id, count(*) AS n_events, arg_max(value, event_version) FILTER (WHERE value > 50) AS big_value, arg_max(props, event_version) FILTER (WHERE event_type = 'DocumentParsedToMarkdown') AS parsed_props FROM log GROUP BY 1""")
def event_fold_bucketed(spark, d):
    """The same from a log that is bucketed by aggregate, written in two appends: folded without an exchange."""
    log = D.log(spark, d).withColumns({"big_value": F.when(F.col("value") > 50, F.col("value")), "parsed_props": F.when(F.col("event_type") == "DocumentParsedToMarkdown", F.col("props"))})
    log = log.select("aggregate_id", "event_version", "big_value", "parsed_props")
    name = f"log_{uuid.uuid4().hex}"
    event_store.create(log.filter("event_version <= 40"), name, shared_folder(spark, "log"), buckets=8)
    event_store.append(log.filter("event_version > 40"), name)
    return E.fold_latest(spark.table(name), ["big_value", "parsed_props"])


@query("""WITH e AS (SELECT event_id, user_id, event_id % 3 AS part, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id) AS n FROM events) SELECT event_id, user_id AS aggregate_id, n::BIGINT AS event_version FROM e""")
def committed_log(spark, d):
    """Three appends to a log that is written by commits; each numbers its events after those that are there."""
    e = D.table(spark, d, "events").select("event_id", F.col("user_id").alias("aggregate_id"), F.col("event_id").alias("seq"))
    at = shared_folder(spark, "commits")
    for part in range(3):
        commits.append_events(e.filter(F.col("event_id") % 3 == part), at)
    log, _ = commits.read(spark, at, "event_id long, aggregate_id long, seq long, event_version int")
    return log.select("event_id", "aggregate_id", F.col("event_version").cast("long").alias("event_version"))


@query("""WITH u AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS seq FROM orders GROUP BY 1) SELECT id, status, seq FROM u WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def committed_upserts(spark, d):
    """Two upserts that overlap, then a deletion, each one commit."""
    o = D.table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").cast("long").alias("seq"))
    at = shared_folder(spark, "commits")
    for half in (o.filter("seq % 2 = 0"), o.filter("seq % 2 = 1")):
        commits.upsert(half, at, ["id"], "seq")
    commits.delete(D.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("long").alias("id")), at, o.schema)
    return commits.read(spark, at, o.schema)[0]


@query(f"""WITH RECURSIVE {D.SQL_LOG}, w(aggregate_id, v, status) AS (
 SELECT DISTINCT aggregate_id, 0::BIGINT, 'PENDING_UPLOAD' FROM log
 UNION ALL
 SELECT w.aggregate_id, l.event_version, CASE l.event_type WHEN 'DocumentAttached' THEN w.status WHEN 'DocumentKnowledgeIndexed' THEN 'INDEXED' WHEN 'DocumentProcessingFailed' THEN 'FAILED'
   WHEN 'DocumentStored' THEN CASE WHEN w.status IN ('PENDING_UPLOAD', 'FAILED') THEN 'UPLOADED' ELSE w.status END
   WHEN 'DocumentParsedToMarkdown' THEN CASE WHEN w.status IN ('PENDING_UPLOAD', 'UPLOADED', 'FAILED') THEN 'PARSED' ELSE w.status END ELSE w.status END
 FROM w JOIN log l ON l.aggregate_id = w.aggregate_id AND l.event_version = w.v + 1)
SELECT aggregate_id, status, v AS last_version FROM w QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY v DESC) = 1""")
def status_state_machine(spark, d):
    return E.document_status(D.log(spark, d)).select("aggregate_id", "status", F.col("last_version").cast("long").alias("last_version"))


@query("""WITH u AS (SELECT user_id AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_type AS step, (value::BIGINT % 100)::INT AS percentage FROM events),
f AS (SELECT *, CASE WHEN step IS DISTINCT FROM lag(step) OVER (PARTITION BY document_id ORDER BY version) THEN 1 ELSE 0 END AS fresh FROM u),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY version) AS run FROM f)
SELECT document_id, version::BIGINT AS version, step, percentage, max(percentage) OVER (PARTITION BY document_id, run ORDER BY version) AS shown FROM g""")
def progress_monotonic(spark, d):
    u = D.log(spark, d).select(F.col("aggregate_id").alias("document_id"), F.col("event_version").cast("long").alias("version"), F.col("kind").alias("step"), (F.bround("value").cast("long") % 100).cast("int").alias("percentage"))
    return E.progress(u)


@query("""WITH o AS (SELECT user_id % 40 AS run_id, user_id AS document_id, CASE event_type WHEN 'purchase' THEN 'indexed' WHEN 'error' THEN 'failed' ELSE 'none' END AS outcome, event_id AS seq, (user_id % 40) % 6 AS total_files FROM events),
l AS (SELECT run_id, document_id, arg_max(outcome, seq) AS outcome FROM o GROUP BY 1, 2), c AS (SELECT run_id, count(*) FILTER (WHERE outcome = 'indexed') AS indexed_files, count(*) FILTER (WHERE outcome = 'failed') AS failed_files FROM l GROUP BY 1),
t AS (SELECT run_id, max(total_files) AS total_files FROM o GROUP BY 1)
SELECT run_id, total_files, indexed_files, failed_files, CASE WHEN total_files = 0 THEN 'COMPLETED' WHEN indexed_files + failed_files < total_files THEN 'RUNNING' WHEN failed_files = 0 THEN 'COMPLETED' WHEN indexed_files = 0 THEN 'FAILED' ELSE 'PARTIALLY_FAILED' END AS status FROM t JOIN c USING (run_id)""")
def run_accounting(spark, d):
    e = D.table(spark, d, "events")
    o = e.select((F.col("user_id") % 40).alias("run_id"), F.col("user_id").alias("document_id"), F.when(F.col("event_type") == "purchase", "indexed").when(F.col("event_type") == "error", "failed").otherwise("none").alias("outcome"), F.col("event_id").alias("seq"), (F.col("user_id") % 40 % 6).alias("total_files"))
    return sync.run_accounting(o)


@query("""WITH t AS (SELECT o_custkey AS document_id, o_orderstatus AS step, o_orderpriority AS task_id, (o_custkey % 5 + 1) AS total FROM orders)
SELECT document_id, step, count(DISTINCT task_id) AS completed, max(total) AS total, count(DISTINCT task_id) >= max(total) AS released FROM t GROUP BY 1, 2""")
def barrier_completion(spark, d):
    return sync.barrier(D.table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("step"), F.col("o_orderpriority").alias("task_id"), (F.col("o_custkey") % 5 + 1).alias("total")))


_STALE = """docs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'UPLOADED' WHEN 'F' THEN 'INDEXED' ELSE 'PARSED' END AS status, o_orderdate AS updated_at, o_custkey % 5 AS recovery_attempt FROM orders),
stale AS (SELECT * FROM docs WHERE status IN ('UPLOADED', 'PARSED', 'CHUNKED', 'RECOVERING') AND updated_at < TIMESTAMP '1996-01-01 00:10:00' - INTERVAL 10 MINUTE AND recovery_attempt < 3 ORDER BY updated_at, id LIMIT 50)"""


def _documents(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "UPLOADED").when(F.col("o_orderstatus") == "F", "INDEXED").otherwise("PARSED")
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), (F.col("o_custkey") % 5).alias("recovery_attempt"))


@query(f"WITH {_STALE} SELECT id, status, recovery_attempt FROM stale")
def stale_documents(spark, d):
    return E.stale_documents(_documents(spark, d), F.lit("1996-01-01 00:10:00").cast("timestamp")).select("id", "status", "recovery_attempt")


@query(f"WITH {_STALE} SELECT d.id, CASE WHEN s.id IS NULL THEN d.status WHEN d.recovery_attempt + 1 >= 3 THEN 'FAILED' ELSE 'RECOVERING' END AS status, d.recovery_attempt + CASE WHEN s.id IS NULL THEN 0 ELSE 1 END AS recovery_attempt FROM docs d LEFT JOIN stale s ON s.id = d.id")
def recovery_lease(spark, d):
    docs = _documents(spark, d)
    return E.recover(docs, E.stale_documents(docs, F.lit("1996-01-01 00:10:00").cast("timestamp"))).select("id", "status", "recovery_attempt")


@query("SELECT p_partkey AS item, p_name AS name, 'file exceeds 50 MiB' AS error FROM part WHERE p_size * 2 * 1024 * 1024 > 50 * 1024 * 1024")
def dlq_failures(spark, d):
    items = D.table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), (F.col("p_size").cast("long") * 2 * 1024 * 1024).alias("size_bytes"))
    return sync.by_size(items)[1].select("item", "name", "error")


@query("""WITH r AS (SELECT o_custkey AS source_id, o_orderkey AS seq, 'c' || o_orderkey AS new_cursor, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS failed FROM orders),
g AS (SELECT source_id, max(seq) FILTER (WHERE failed = 0) AS good_at, arg_max(new_cursor, seq) FILTER (WHERE failed = 0) AS cursor, max(seq) FILTER (WHERE failed > 0) AS bad_at, arg_max(new_cursor, seq) FILTER (WHERE failed > 0) AS bad FROM r GROUP BY 1)
SELECT source_id, cursor, CASE WHEN bad_at > coalesce(good_at, -1) THEN bad END AS pending_cursor FROM g""")
def cursor_commit(spark, d):
    return sync.next_cursor(D.table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("new_cursor"), (F.col("o_orderstatus") == "F").cast("int").alias("failed")))


@query("SELECT o_orderkey AS item, CASE WHEN o_orderstatus = 'F' THEN 'reprocess' WHEN o_orderpriority NOT LIKE '1%' THEN 'download' ELSE 'unrecoverable' END AS route FROM orders")
def retry_routing(spark, d):
    dead = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")).alias("doc_id"), F.when(~F.col("o_orderpriority").startswith("1"), "x").otherwise("").alias("external_id"))
    return sync.retry_routes(dead).select("item", "route")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderstatus IN ('F', 'O') AND (o_custkey % 3) = (l_suppkey % 3))")
def idempotency_anti_join(spark, d):
    items = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("external_id"), (F.col("l_suppkey") % 3).alias("version_hash"))
    have = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("external_id"), (F.col("o_custkey") % 3).alias("version_hash"), F.col("o_orderstatus").alias("status"))
    return sync.gate(items, have, ("F", "O")).select("l_orderkey", "l_linenumber")


@query("WITH last AS (SELECT p_name, arg_max(p_partkey, p_retailprice * 1000000 + p_partkey) AS replaces_doc_id FROM part WHERE p_size > 10 GROUP BY 1) SELECT p_partkey, replaces_doc_id FROM part LEFT JOIN last USING (p_name)")
def replaces_lookup(spark, d):
    p = D.table(spark, d, "part")
    items = p.select("p_partkey", F.col("p_name").alias("file_name"))
    docs = p.filter("p_size > 10").select(F.col("p_name").alias("file_name"), F.col("p_partkey").alias("doc_id"), (F.col("p_retailprice") * 1000000 + F.col("p_partkey")).alias("ord"))
    return sync.replaces(items, docs).select("p_partkey", "replaces_doc_id")


@query("SELECT c_custkey AS doc_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)")
def swap_anti_join(spark, d):
    docs = D.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    indexed = D.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.when(F.col("o_totalprice") > 200000, F.col("o_custkey")).alias("replaces_doc_id"))
    return sync.swap(docs, indexed)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))) GROUP BY 1")
def cascade_delete(spark, d):
    kb = D.table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    docs = D.table(spark, d, "customer").join(kb, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    parts = D.table(spark, d, "orders").join(docs, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return E.cascade_delete(D.table(spark, d, "lineitem"), parts, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT user_id AS caller, epoch(ts)::BIGINT AS at_seconds, event_id, 100 AS tokens FROM events)
SELECT event_id, count(*) OVER w AS requests, (sum(tokens) OVER w)::BIGINT AS tokens_used FROM c WINDOW w AS (PARTITION BY caller ORDER BY at_seconds RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)""")
def rate_window_usage(spark, d):
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")  # the nearest second, of two the even one, as the SQL's cast
    c = D.table(spark, d, "events").select("event_id", F.col("user_id").alias("caller"), at.alias("at_seconds"), F.lit(100).alias("tokens"))
    return sync.usage_in_window(c, 3600).select("event_id", "requests", "tokens_used")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props_extract(spark, d):
    v = F.try_parse_json("props")
    return D.table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"))


#: A walk over each source's events, state by state; ``error`` tells a start that the state before forbids.
SQL_SOURCES = """k AS (SELECT user_id AS source_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'enabled' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'disabled' ELSE 'completed' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT DISTINCT source_id, 0::BIGINT AS n, NULL::BIGINT AS seq, 'IDLE' AS status, NULL::VARCHAR AS error FROM k
 UNION ALL SELECT k.source_id, k.n, k.seq, CASE WHEN kind = 'started' AND w.status IN ('DISABLED', 'SYNCING') THEN w.status WHEN kind = 'started' THEN 'SYNCING' WHEN kind = 'failed' THEN 'FAILED' WHEN kind = 'disabled' THEN 'DISABLED' ELSE 'IDLE' END,
  CASE WHEN kind = 'started' AND w.status = 'DISABLED' THEN 'DATA_SOURCE_DISABLED' WHEN kind = 'started' AND w.status = 'SYNCING' THEN 'DATA_SOURCE_ALREADY_SYNCING' END FROM w JOIN k ON k.source_id = w.source_id AND k.n = w.n + 1)"""


@query(f"WITH RECURSIVE {SQL_SOURCES} SELECT source_id, arg_max(status, n) AS status FROM w GROUP BY 1")
def data_source_status(spark, d):
    kind = F.when(F.col("event_type") == "signup", "enabled").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "started").when(F.col("event_type") == "purchase", "disabled").otherwise("completed")
    return sync.source_status(D.table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), kind.alias("kind")))


@query("""WITH RECURSIVE f AS (SELECT c_custkey AS folder_id, c_custkey // 3 AS parent_id FROM customer), r AS (SELECT 1 AS folder_id, 0 AS depth UNION ALL SELECT f.folder_id, r.depth + 1 FROM r JOIN f ON f.parent_id = r.folder_id WHERE f.folder_id <> 1)
SELECT o_orderkey AS file_id, o_custkey AS folder_id, depth::BIGINT AS depth FROM orders JOIN (SELECT folder_id, min(depth) AS depth FROM r GROUP BY 1) ON folder_id = o_custkey""")
def folder_walk_recursive(spark, d):
    links = D.table(spark, d, "customer").select(F.col("c_custkey").alias("folder_id"), F.floor(F.col("c_custkey") / 3).alias("parent_id"))
    files = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("folder_id"))
    return files.join(discovery.walk(links, 1, native.shared_folder(spark, "walks")), "folder_id").select("file_id", "folder_id", "depth")


@query("""WITH r AS (SELECT l_partkey AS file_id, l_suppkey % 4 AS parent_id, l_returnflag = 'R' AS gone, ((l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey) * 2 + (l_returnflag = 'R')::INT AS seq FROM lineitem),
l AS (SELECT file_id, arg_max(parent_id, seq) AS parent_id, arg_max(gone, seq) AS gone FROM r GROUP BY 1)
SELECT file_id, gone AS deleted FROM l WHERE gone OR parent_id = 2""")
def change_feed_delta(spark, d):
    c = D.table(spark, d, "lineitem").select(F.col("l_partkey").alias("file_id"), (F.col("l_suppkey") % 4).alias("parent_id"), (F.col("l_returnflag") == "R").alias("removed"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")) * 2 + (F.col("l_returnflag") == "R").cast("int")).alias("seq"))
    kept, gone = discovery.delta(c, spark.createDataFrame([("2",)], "folder_id string"), [], F.lit("2026-01-01").cast("timestamp"))
    return kept.select(F.col("external_id").cast("long").alias("file_id"), F.lit(False).alias("deleted")).unionByName(gone.select(F.col("file_id").cast("long").alias("file_id"), F.lit(True).alias("deleted")))


@query(f"WITH {D.SQL_LOG} , gone AS (SELECT aggregate_id, min(event_version) AS e FROM log WHERE event_type = 'DocumentProcessingFailed' AND value > 90 GROUP BY 1) SELECT event_id FROM log LEFT JOIN gone USING (aggregate_id) WHERE e IS NULL OR event_version <= e")
def tombstone_rule(spark, d):
    log = D.log(spark, d)
    deleted = (F.col("event_type") == "DocumentProcessingFailed") & (F.col("value") > 90)
    return E.drop_after_delete(log.withColumn("event_type", F.when(deleted, E.DELETED).otherwise(F.col("event_type")))).select("event_id")


@query("SELECT n_name AS kb, r_name AS ontology FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_name LIKE '%A%'")
def kb_ontology_left_join(spark, d):
    kb, o = D.table(spark, d, "nation"), D.table(spark, d, "region").filter("r_name LIKE '%A%'")
    return kb.join(o, kb.n_regionkey == o.r_regionkey, "left").select(F.col("n_name").alias("kb"), F.col("r_name").alias("ontology"))


@query("SELECT n_nationkey AS kb_id, count(c_custkey) AS documents_count, count(c_custkey) FILTER (WHERE c_acctbal > 0) AS indexed, count(c_custkey) FILTER (WHERE c_acctbal <= 0) AS failed FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY' GROUP BY 1")
def kb_document_counts(spark, d):
    docs = D.table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").groupBy("c_nationkey").agg(F.count("*").alias("documents_count"), F.count_if(F.col("c_acctbal") > 0).alias("indexed"), F.count_if(F.col("c_acctbal") <= 0).alias("failed"))
    kb = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("kb_id"))
    return kb.join(docs, kb.kb_id == docs.c_nationkey, "left").drop("c_nationkey").na.fill(0)


@query("SELECT n_nationkey AS kb_id, coalesce(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) FILTER (WHERE c_custkey IS NOT NULL), '') AS documents FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 8000 GROUP BY 1")
def nested_documents(spark, d):
    docs = D.table(spark, d, "customer").filter("c_acctbal > 8000").select(F.col("c_nationkey").alias("kb_id"), F.col("c_custkey").alias("document_id"))
    nested = lifecycle.with_documents(D.table(spark, d, "nation").select(F.col("n_nationkey").alias("kb_id")), docs, ["document_id"])
    return nested.select("kb_id", F.array_join(F.transform("documents", lambda x: x["document_id"].cast("string")), ",").alias("documents"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def newest_runs(spark, d):
    runs = D.table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    return lifecycle.newest_runs(runs, 3).select(F.col("source_id").alias("o_custkey"), F.col("run_id").alias("o_orderkey"))


@query("""WITH o AS (SELECT r_regionkey AS ontology_id FROM region UNION ALL SELECT r_regionkey + 100 FROM region)
SELECT ontology_id, count(n_nationkey) AS used_by, count(n_nationkey) = 0 AS deletable FROM o LEFT JOIN nation ON n_regionkey = ontology_id GROUP BY 1""")
def ontology_usage(spark, d):
    from strataloom.operators import ontology

    kbs = D.table(spark, d, "nation").select(F.col("n_regionkey").alias("ontology_id"))
    r = D.table(spark, d, "region")
    drafts = r.select((F.col("r_regionkey") + 100).alias("ontology_id"))  # templates that no base uses
    return ontology.usage(r.select(F.col("r_regionkey").alias("ontology_id")).unionByName(drafts), kbs)


@query("WITH f AS (SELECT c_mktsegment AS label, min(c_custkey) AS id FROM customer GROUP BY 1) SELECT DISTINCT a.id AS source_id, b.id AS target_id, 'LIKE' AS rel_type FROM f a JOIN f b ON a.label = 'BUILDING' AND b.label IN ('MACHINERY', 'AUTOMOBILE')")
def relation_ends_by_type(spark, d):
    from strataloom.operators import ontology

    nodes = D.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("label"))
    r = spark.createDataFrame([("BUILDING", "MACHINERY", "LIKE"), ("BUILDING", "AUTOMOBILE", "LIKE"), ("BUILDING", "none", "LIKE")], "source_type string, target_type string, rel_type string")
    return ontology.ends_by_type(r, nodes)


@query("""WITH c AS (SELECT event_id, greatest(least(greatest(floor(value)::BIGINT, 1), 120) * 8, 120) AS cost FROM events), m AS (SELECT max(cost) FILTER (cost * 2 <= 960) AS widest, sum(cost) FILTER (cost * 2 <= 960) AS whole FROM c),
small AS (SELECT event_id, sum(cost) OVER (ORDER BY event_id) - cost AS b FROM c WHERE cost * 2 <= 960),
large AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM c WHERE cost * 2 > 960)
SELECT event_id, ((b * 60000 + 960 - widest - 1) // (960 - widest))::BIGINT AS start_ms FROM small, m UNION ALL SELECT event_id, (k * 60000 + (whole * 60000) // (960 - widest) + 60000)::BIGINT FROM large, m""")
def admission_plan(spark, d):
    """When each call of the log may start, under 8 requests and 120 tokens a minute for all callers together."""
    e = D.table(spark, d, "events").select(F.col("event_id").alias("call_id"), F.col("event_id").alias("seq"), F.floor("value").alias("tokens"))
    return admission.plan(e, 8, 120).select(F.col("call_id").alias("event_id"), "start_ms")
