"""Queries of retrieval and of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import comention, graph, retrieval, vector_index
from strataloom.plans import data as D
from strataloom.plans.registry import query
from strataloom.storage import shared_folder

K, TOP = 50, 20
_BASE = f"{D.SQL_CHILDREN}, {D.SQL_PARENTS}, {D.SQL_MENTIONS}, {D.SQL_QUERY}, {D.SQL_KNN}, seeds AS (SELECT parent_id, max(score) AS seed_score FROM knn JOIN parents USING (parent_id) GROUP BY parent_id)"
_PAIRS = """pairs AS (SELECT s.parent_id, s.seed_score, b.parent_id AS neighbour_id, count(DISTINCT a.entity_id) AS shared FROM seeds s JOIN mentions a ON a.parent_id = s.parent_id JOIN mentions b ON b.entity_id = a.entity_id AND b.parent_id <> a.parent_id GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY shared DESC, neighbour_id) AS n FROM pairs) WHERE n <= 5)"""
_FUSED = """candidates AS (SELECT parent_id, seed_score AS base_score, 0 AS shared, true AS is_seed FROM seeds UNION ALL SELECT neighbour_id, seed_score * 0.7::DOUBLE, shared, false FROM near),
fused AS (SELECT parent_id, max(base_score) AS base_score, max(shared) AS shared, bool_or(is_seed) AS is_seed FROM candidates GROUP BY parent_id),
scored AS (SELECT *, CASE WHEN is_seed THEN base_score ELSE base_score * (1 + least(shared, 5) * 0.05::DOUBLE) END AS fused_score FROM fused)"""
_RANKED = f"WITH {_BASE}, {_PAIRS}, {_FUSED}, ranked AS (SELECT * FROM scored ORDER BY fused_score DESC, parent_id LIMIT {TOP})"


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.seeds(retrieval.nearest(D.children(spark, d), D.query_vector(spark, d), K), D.parents(spark, d))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(D.children(spark, d), D.parents(spark, d), D.mentions(spark, d), D.query_vector(spark, d), top_k=TOP, candidate_k=K)


@query(f"{_RANKED} SELECT parent_id, round(base_score, 6) AS base_score, shared::BIGINT AS shared, is_seed, round(fused_score, 6) AS fused_score FROM ranked")
def hybrid_retrieval(spark, d):
    r = _ranked(spark, d)
    return r.select("parent_id", F.round("base_score", 6).alias("base_score"), "shared", "is_seed", F.round("fused_score", 6).alias("fused_score"))


@query(f"""{_RANKED}, {D.SQL_ENTITIES}, {D.SQL_RELATIONS},
sentences AS (SELECT r.source_id, a.name || ' ' || r.rel_type || ' ' || b.name AS triple FROM relations r JOIN entities a ON a.entity_id = r.source_id JOIN entities b ON b.entity_id = r.target_id),
hits AS (SELECT DISTINCT parent_id, triple FROM ranked JOIN mentions USING (parent_id) JOIN sentences ON source_id = entity_id),
five AS (SELECT parent_id, string_agg(triple, '; ' ORDER BY triple) AS triples FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY triple) AS n FROM hits) WHERE n <= 5 GROUP BY parent_id),
named AS (SELECT parent_id, string_agg(DISTINCT 'Nation:' || name, '; ' ORDER BY 'Nation:' || name) AS entities FROM ranked JOIN mentions USING (parent_id) JOIN entities USING (entity_id) GROUP BY parent_id),
ordered AS (SELECT parent_id, document_id, source_type, lag(parent_id) OVER w AS prev_chunk_id, lead(parent_id) OVER w AS next_chunk_id FROM parents WINDOW w AS (PARTITION BY document_id ORDER BY parent_index, parent_id))
SELECT parent_id, document_id, source_type, coalesce(prev_chunk_id, -1) AS prev_chunk_id, coalesce(next_chunk_id, -1) AS next_chunk_id, CASE WHEN is_seed THEN 'vector_match' ELSE 'graph_expansion' END AS retrieval_source,
       round(fused_score, 6) AS relevance_score, coalesce(triples, '') AS triples, coalesce(entities, '') AS entities, 'customer ' || document_id AS document_name
FROM ranked LEFT JOIN ordered USING (parent_id) LEFT JOIN five USING (parent_id) LEFT JOIN named USING (parent_id)""")
def hybrid_enriched(spark, d):
    p = D.parents(spark, d)
    docs = p.select("document_id").distinct().withColumn("name", F.concat(F.lit("customer "), F.col("document_id").cast("string")))
    r = retrieval.enriched(_ranked(spark, d), p, docs, D.mentions(spark, d), D.relations(spark, d), D.entities(spark, d))
    text = lambda c: F.coalesce(F.array_join(c, "; "), F.lit(""))
    return r.select("parent_id", "document_id", "source_type", F.coalesce("prev_chunk_id", F.lit(-1)).alias("prev_chunk_id"), F.coalesce("next_chunk_id", F.lit(-1)).alias("next_chunk_id"), "retrieval_source", F.round("fused_score", 6).alias("relevance_score"), text("related_triples").alias("triples"), text("related_entities").alias("entities"), "document_name")


@query(f"WITH {D.SQL_CHILDREN}, {D.SQL_QUERY}, {D.SQL_KNN} SELECT child_id, parent_id, round(score, 6) AS score FROM knn")
def knn_topk(spark, d):
    return retrieval.nearest(D.children(spark, d), D.query_vector(spark, d), K).select("child_id", "parent_id", F.round("score", 6).alias("score"))


@query(f"WITH {D.SQL_CHILDREN}, {D.SQL_QUERY}, {D.SQL_KNN} SELECT child_id, parent_id, round(score, 6) AS score FROM knn")
def knn_indexed(spark, d):
    """The same through an inverted file; lists that could hold more are read too, so nothing is missed."""
    index = vector_index.build(D.children(spark, d), shared_folder(spark, "index"), k=K)
    found, _ = vector_index.nearest(spark, index, D.query_vector(spark, d), K, exact=True)
    return found.select("child_id", "parent_id", F.round("score", 6).alias("score"))


@query(f"WITH {D.SQL_CHILDREN}, {D.SQL_QUERIES}, {D.SQL_KNN_MANY} SELECT query_id, child_id, parent_id, round(score, 6) AS score FROM knn")
def knn_many(spark, d):
    """The nearest chunks of all query vectors at once."""
    return vector_index.nearest_many(D.children(spark, d), D.query_vectors(spark, d), K).select("query_id", "child_id", "parent_id", F.round("score", 6).alias("score"))


@query()
def knn_many_indexed(spark, d):
    """The same through the inverted file's nearest lists only; a test measures what share of ``knn_many`` it finds."""
    index = vector_index.build(D.children(spark, d), shared_folder(spark, "index"), k=K)
    return vector_index.nearest_many_indexed(spark, index, D.query_vectors(spark, d), K).select("query_id", "child_id", "parent_id", F.round("score", 6).alias("score"))


_MANY = f"""WITH {D.SQL_CHILDREN}, {D.SQL_PARENTS}, {D.SQL_MENTIONS}, {D.SQL_QUERIES}, {D.SQL_KNN_MANY},
seeds AS (SELECT query_id, parent_id, max(score) AS seed_score FROM knn JOIN parents USING (parent_id) GROUP BY ALL),
pairs AS (SELECT s.query_id, s.parent_id, s.seed_score, b.parent_id AS neighbour_id, count(DISTINCT a.entity_id) AS shared FROM seeds s JOIN mentions a ON a.parent_id = s.parent_id JOIN mentions b ON b.entity_id = a.entity_id AND b.parent_id <> a.parent_id GROUP BY ALL),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY shared DESC, neighbour_id) <= 5),
candidates AS (SELECT query_id, parent_id, seed_score AS base_score, 0 AS shared, true AS is_seed FROM seeds UNION ALL SELECT query_id, neighbour_id, seed_score * 0.7::DOUBLE, shared, false FROM near),
fused AS (SELECT query_id, parent_id, max(base_score) AS base_score, max(shared) AS shared, bool_or(is_seed) AS is_seed FROM candidates GROUP BY ALL),
scored AS (SELECT *, CASE WHEN is_seed THEN base_score ELSE base_score * (1 + least(shared, 5) * 0.05::DOUBLE) END AS fused_score FROM fused),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, parent_id) AS rank FROM scored QUALIFY rank <= {TOP})"""


def _many(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid_many(D.children(spark, d), D.parents(spark, d), D.mentions(spark, d), D.query_vectors(spark, d), top_k=TOP, candidate_k=K)


@query(f"{_MANY} SELECT query_id, rank, parent_id, round(base_score, 6) AS base_score, shared::BIGINT AS shared, is_seed, round(fused_score, 6) AS fused_score FROM ranked")
def hybrid_many(spark, d):
    """Hybrid retrieval for all query vectors at once."""
    return _many(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "parent_id", F.round("base_score", 6).alias("base_score"), "shared", "is_seed", F.round("fused_score", 6).alias("fused_score"))


@query(f"""{_MANY}, {D.SQL_ENTITIES}, {D.SQL_RELATIONS}, ids AS (SELECT DISTINCT parent_id FROM ranked),
sentences AS (SELECT r.source_id, a.name || ' ' || r.rel_type || ' ' || b.name AS triple FROM relations r JOIN entities a ON a.entity_id = r.source_id JOIN entities b ON b.entity_id = r.target_id),
hits AS (SELECT DISTINCT parent_id, triple FROM ids JOIN mentions USING (parent_id) JOIN sentences ON source_id = entity_id),
five AS (SELECT parent_id, string_agg(triple, '; ' ORDER BY triple) AS triples FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY triple) AS n FROM hits) WHERE n <= 5 GROUP BY parent_id),
named AS (SELECT parent_id, string_agg(DISTINCT entity_id || ' Nation ' || name, '; ' ORDER BY entity_id || ' Nation ' || name) AS entities FROM ids JOIN mentions USING (parent_id) JOIN entities USING (entity_id) GROUP BY parent_id),
ordered AS (SELECT parent_id, document_id, lag(parent_id) OVER w AS prev_chunk_id, lead(parent_id) OVER w AS next_chunk_id FROM parents WINDOW w AS (PARTITION BY document_id ORDER BY parent_index, parent_id))
SELECT query_id, rank, parent_id, 'customer ' || document_id AS document_name, coalesce(prev_chunk_id, -1) AS prev_chunk_id, coalesce(next_chunk_id, -1) AS next_chunk_id, CASE WHEN is_seed THEN 'vector_match' ELSE 'graph_expansion' END AS retrieval_source,
 coalesce(triples, '') AS triples, coalesce(entities, '') AS entities FROM ranked LEFT JOIN ordered USING (parent_id) LEFT JOIN five USING (parent_id) LEFT JOIN named USING (parent_id)""")
def hybrid_many_enriched(spark, d):
    p = D.parents(spark, d)
    docs = p.select("document_id").distinct().withColumn("name", F.concat(F.lit("customer "), F.col("document_id").cast("string")))
    r = retrieval.enriched_many(_many(spark, d), p, docs, D.mentions(spark, d), D.relations(spark, d), D.entities(spark, d))
    field = lambda e, f: F.get_json_object(e["properties"], f"$.{f}")
    entities = F.array_join(F.array_sort(F.transform("entities", lambda e: F.concat_ws(" ", field(e, "id"), e["type"], field(e, "name")))), "; ")
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "parent_id", "document_name", F.coalesce("prev_chunk_id", F.lit(-1)).alias("prev_chunk_id"), F.coalesce("next_chunk_id", F.lit(-1)).alias("next_chunk_id"), "retrieval_source", F.coalesce(F.array_join("related_triples", "; "), F.lit("")).alias("triples"), F.coalesce(entities, F.lit("")).alias("entities"))


@query(f"WITH {D.SQL_CHILDREN}, {D.SQL_PARENTS}, {D.SQL_QUERY}, {D.SQL_KNN} SELECT parent_id, round(max(score), 6) AS seed_score FROM knn JOIN parents USING (parent_id) WHERE source_type IN ('image', 'audio') AND ingested_at >= 1700005000 AND ingested_at <= 1700090000 GROUP BY parent_id")
def knn_postfilter(spark, d):
    f = retrieval.Filters(source_types=("image", "audio"), time_from=1700005000.0, time_to=1700090000.0)
    return retrieval.seeds(retrieval.nearest(D.children(spark, d), D.query_vector(spark, d), K), D.parents(spark, d), f).select("parent_id", F.round("seed_score", 6).alias("seed_score"))


@query(f"WITH {_BASE} SELECT parent_id, round(seed_score, 6) AS seed_score FROM seeds")
def parent_rollup_max(spark, d):
    return _seeds(spark, d).select("parent_id", F.round("seed_score", 6).alias("seed_score"))


@query(f"WITH {_BASE}, {_PAIRS} SELECT parent_id, neighbour_id, shared::BIGINT AS shared FROM near")
def comention_neighbors(spark, d):
    return retrieval.neighbours(_seeds(spark, d), D.mentions(spark, d)).select("parent_id", "neighbour_id", "shared")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS parent_id, l_partkey AS entity_id FROM lineitem), p AS (SELECT a.parent_id, b.parent_id AS neighbour_id, count(*) AS shared FROM m a JOIN m b ON a.entity_id = b.entity_id AND a.parent_id <> b.parent_id WHERE a.parent_id % 50 = 0 GROUP BY ALL)
SELECT parent_id, neighbour_id, shared FROM p QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY shared DESC, neighbour_id) <= 5""")
def comention_orders(spark, d):
    """A search: the orders whose number is divisible by 50 against all orders, by the parts that they share."""
    m = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_partkey").alias("entity_id"))
    wanted = m.filter("parent_id % 50 = 0").select("parent_id").distinct().withColumn("seed_score", F.lit(1.0))
    return retrieval.neighbours(wanted, m).select("parent_id", "neighbour_id", "shared")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS parent_id, l_partkey AS entity_id FROM lineitem UNION SELECT l_orderkey, -1 - ascii(l_returnflag) FROM lineitem WHERE l_orderkey % 10 = 0),
p AS (SELECT a.parent_id, b.parent_id AS neighbour_id, count(*) AS shared FROM m a JOIN m b ON a.entity_id = b.entity_id AND a.parent_id <> b.parent_id GROUP BY ALL)
SELECT parent_id, neighbour_id, shared FROM p QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY shared DESC, neighbour_id) <= 5""")
def comention_all(spark, d):
    """All orders as seeds; a tenth of them mention, besides their parts, marks that hundreds mention."""
    li = D.table(spark, d, "lineitem")
    marks = li.filter("l_orderkey % 10 = 0").select(F.col("l_orderkey").alias("parent_id"), (-1 - F.ascii("l_returnflag")).cast("long").alias("entity_id"))
    m = li.select(F.col("l_orderkey").alias("parent_id"), F.col("l_partkey").cast("long").alias("entity_id")).unionByName(marks)
    return comention.all_neighbours(m, heavy=200).select("parent_id", "neighbour_id", "shared")


@query(f"WITH {_BASE}, {_PAIRS}, {_FUSED} SELECT parent_id, round(base_score, 6) AS base_score, shared::BIGINT AS shared, is_seed, round(fused_score, 6) AS fused_score FROM scored")
def candidate_fusion(spark, d):
    s = _seeds(spark, d)
    r = retrieval.fuse(s, retrieval.neighbours(s, D.mentions(spark, d)))
    return r.select("parent_id", F.round("base_score", 6).alias("base_score"), "shared", "is_seed", F.round("fused_score", 6).alias("fused_score"))


@query("""WITH RECURSIVE p AS (SELECT conv_id, turn AS rank, coalesce(text, '') AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE ceil(length(text) / 3.3::DOUBLE)::BIGINT END AS cost FROM conversations),
walk AS (SELECT conv_id, 0::BIGINT AS pos, 0::BIGINT AS used, false AS stopped, NULL::BIGINT AS rank, ''::VARCHAR AS content, false AS kept, false AS truncated FROM (SELECT DISTINCT conv_id FROM p)
 UNION ALL
 SELECT p.conv_id, p.pos, w.used + CASE WHEN w.used + p.cost <= 300 THEN p.cost ELSE 0 END, w.used + p.cost > 300, p.rank,
   CASE WHEN w.used + p.cost <= 300 THEN p.content ELSE regexp_replace(substr(p.content, 1, greatest(20, floor(greatest(1, 300 - w.used - 9) * 3.3::DOUBLE)::BIGINT)::BIGINT), '[\\s]+$', '') || '... [truncado pelo orçamento]' END,
   w.used + p.cost <= 300 OR p.pos = 1 OR 300 - w.used >= 59, w.used + p.cost > 300
 FROM walk w JOIN p ON p.conv_id = w.conv_id AND p.pos = w.pos + 1 WHERE NOT w.stopped)
SELECT conv_id, rank, content, truncated, CASE WHEN length(content) = 0 THEN 0 ELSE ceil(length(content) / 3.3::DOUBLE)::BIGINT END AS tokens FROM walk WHERE pos > 0 AND kept""".replace("\\\\", "\\"))
def token_budget_cut(spark, d):
    c = D.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("rank"), F.coalesce("text", F.lit("")).alias("content"))
    return retrieval.budget_cut(c, 300, by=["conv_id"]).select("conv_id", "rank", "content", "truncated", F.col("tokens").cast("long").alias("tokens"))


@query("SELECT o_orderkey, coalesce(lag(o_orderkey) OVER w, -1) AS prev_chunk_id, coalesce(lead(o_orderkey) OVER w, -1) AS next_chunk_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def prev_next_chunks(spark, d):
    p = D.table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderdate").alias("parent_index"), F.col("o_orderkey").alias("parent_id"))
    return retrieval.with_neighbour_chunks(p).select(F.col("parent_id").alias("o_orderkey"), F.coalesce("prev_chunk_id", F.lit(-1)).alias("prev_chunk_id"), F.coalesce("next_chunk_id", F.lit(-1)).alias("next_chunk_id"))


@query(f"""WITH {D.SQL_MENTIONS}, {D.SQL_ENTITIES}, {D.SQL_RELATIONS},
sentences AS (SELECT r.source_id, a.name || ' ' || r.rel_type || ' ' || b.name AS triple FROM relations r JOIN entities a ON a.entity_id = r.source_id JOIN entities b ON b.entity_id = r.target_id),
hits AS (SELECT DISTINCT parent_id, triple FROM mentions JOIN sentences ON source_id = entity_id)
SELECT parent_id, string_agg(triple, '; ' ORDER BY triple) AS triples FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY triple) AS n FROM hits) WHERE n <= 5 GROUP BY parent_id""")
def related_triples(spark, d):
    m = D.mentions(spark, d)
    r = retrieval.triples(m.select("parent_id").distinct(), m, D.relations(spark, d), D.entities(spark, d))
    return r.select("parent_id", F.array_join("related_triples", "; ").alias("triples"))


@query(f"""{_RANKED}, {D.SQL_ENTITIES}, {D.SQL_RELATIONS},
sentences AS (SELECT r.source_id, a.name || ' ' || r.rel_type || ' ' || b.name AS triple FROM relations r JOIN entities a ON a.entity_id = r.source_id JOIN entities b ON b.entity_id = r.target_id),
places AS (SELECT parent_id, row_number() OVER (ORDER BY fused_score DESC, parent_id) AS rank FROM ranked),
hits AS (SELECT DISTINCT parent_id, rank, triple FROM places JOIN mentions USING (parent_id) JOIN sentences ON source_id = entity_id),
five AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY triple) - 1 AS pos FROM hits QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY triple) <= 5)
SELECT triple, (min(rank * 100 + pos) // 100)::BIGINT AS rank, (min(rank * 100 + pos) % 100)::BIGINT AS pos FROM five GROUP BY triple ORDER BY rank, pos LIMIT 10""")
def unique_triples(spark, d):
    r = _ranked(spark, d)
    t = retrieval.triples(r, D.mentions(spark, d), D.relations(spark, d), D.entities(spark, d))
    places = r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fused_score"), "parent_id")).cast("long"))  # twenty rows
    return retrieval.unique_triples(places.join(t, "parent_id").select("rank", "related_triples")).select("triple", "rank", F.col("pos").cast("long").alias("pos"))


@query("SELECT o_custkey AS document_id, o_orderkey AS parent_id, next_id FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_id FROM orders) WHERE next_id IS NOT NULL")
def next_edges(spark, d):
    return graph.next_edges(D.table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderdate").alias("parent_index"), F.col("o_orderkey").alias("parent_id")))


@query(f"""WITH {D.SQL_CHILDREN}, {D.SQL_PARENTS}, p AS (SELECT document_id, count(*) AS p FROM parents GROUP BY 1), c AS (SELECT document_id, count(*) AS c FROM children JOIN parents USING (parent_id) GROUP BY 1)
SELECT document_id, 1 + p + c AS n_nodes, p + c + greatest(p - 1, 0) AS n_edges FROM p JOIN c USING (document_id)""")
def structure_counts(spark, d):
    p = D.parents(spark, d)
    return graph.structure_counts(p, D.children(spark, d).join(p.select("parent_id", "document_id"), "parent_id"))


_EDGES = "edges AS (SELECT ' P' || l_partkey || ' ' AS source_id, 's' || l_suppkey AS target_id, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), nodes AS (SELECT 'p' || p_partkey AS entity_id FROM part WHERE p_size > 25 UNION ALL SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0)"


@query(f"WITH {_EDGES} SELECT seq FROM edges WHERE lower(trim(source_id)) IN (SELECT lower(trim(entity_id)) FROM nodes) AND lower(trim(target_id)) IN (SELECT lower(trim(entity_id)) FROM nodes)")
def dangling_edge_filter(spark, d):
    li = D.table(spark, d, "lineitem").select(F.concat(F.lit(" P"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("source_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    nodes = D.table(spark, d, "part").filter("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id")).unionByName(D.table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity_id")))
    return graph.referential(li, nodes).select("seq")


@query("""WITH v AS (SELECT o_orderstatus AS label, o_custkey AS entity_id, k AS key, arg_max(v, o_orderkey) AS value FROM (SELECT o_orderstatus, o_custkey, o_orderkey, unnest(['priority', 'year' || (o_orderkey % 3)]) AS k, unnest([o_orderpriority, year(o_orderdate)::VARCHAR]) AS v FROM orders) GROUP BY 1, 2, 3)
SELECT label, entity_id, string_agg(key || '=' || value, ',' ORDER BY key) AS properties FROM v GROUP BY 1, 2""")
def node_merge_dedup(spark, d):
    o = D.table(spark, d, "orders")
    year = F.year(F.col("o_orderdate")).cast("string")
    rows = o.select(F.col("o_orderstatus").alias("label"), F.col("o_custkey").alias("entity_id"), F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.concat(F.lit("year"), (F.col("o_orderkey") % 3).cast("string")), year).alias("properties"), F.col("o_orderkey").alias("seq"))
    m = graph.merge_nodes(None, rows)
    return m.select("label", "entity_id", F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("properties"))


@query("""WITH e AS (SELECT l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS rel_type, unnest(['quantity', 'mode' || l_linenumber]) AS k, unnest([l_quantity::BIGINT::VARCHAR, l_linestatus]) AS v, 1 AS age, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity::BIGINT AS seq FROM lineitem),
ids AS (SELECT p_partkey AS id FROM part WHERE p_size <= 40), old AS (SELECT s_suppkey AS source_id, s_suppkey AS target_id, 'R' AS rel_type, 'since' AS k, s_nationkey::VARCHAR AS v, 0 AS age, 0 AS seq FROM supplier UNION ALL SELECT p_partkey, p_partkey % 100, 'N', 'quantity', 'none', 0, 0 FROM part),
all_ AS (SELECT * FROM e WHERE source_id IN (SELECT id FROM ids) AND target_id IN (SELECT id FROM ids) UNION ALL SELECT * FROM old),
m AS (SELECT source_id, target_id, rel_type, k, arg_max(v, age * 1000000000000 + seq) AS v FROM all_ GROUP BY 1, 2, 3, 4)
SELECT source_id, target_id, rel_type, string_agg(k || '=' || v, ',' ORDER BY k) AS properties FROM m GROUP BY 1, 2, 3""")
def edge_merge_dedup(spark, d):
    """Edges between known nodes merged, property by property, into those that are there."""
    entry = lambda *kv: F.create_map(*kv)
    e = D.table(spark, d, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("rel_type"), entry(F.lit("quantity"), F.col("l_quantity").cast("long").cast("string"), F.concat(F.lit("mode"), F.col("l_linenumber").cast("string")), F.col("l_linestatus")).alias("properties"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_quantity").cast("long")).alias("seq"))
    part = D.table(spark, d, "part")
    old = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_suppkey").alias("target_id"), F.lit("R").alias("rel_type"), entry(F.lit("since"), F.col("s_nationkey").cast("string")).alias("properties"), F.lit(0).cast("long").alias("seq"))
    old = old.unionByName(part.select(F.col("p_partkey").alias("source_id"), (F.col("p_partkey") % 100).alias("target_id"), F.lit("N").alias("rel_type"), entry(F.lit("quantity"), F.lit("none")).alias("properties"), F.lit(0).cast("long").alias("seq")))
    m = graph.merge_edges(old, e, part.filter("p_size <= 40").select(F.col("p_partkey").alias("entity_id")))
    return m.select("source_id", "target_id", "rel_type", F.array_join(F.transform(F.map_entries("properties"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("properties"))


@query("""WITH gone AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'), kept AS (SELECT o_orderkey AS parent_id FROM orders WHERE o_custkey NOT IN (SELECT id FROM gone))
SELECT l_orderkey AS parent_id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT parent_id FROM kept) GROUP BY 1""")
def subgraph_delete(spark, d):
    docs = D.table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), "c_mktsegment")
    parents = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("parent_id"), F.col("o_custkey").alias("document_id"))
    mentions = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_partkey").alias("entity_id"))
    left = graph.without_document(docs, parents, parents, mentions, docs.filter("c_mktsegment = 'BUILDING'"))
    return left["mentions"].groupBy("parent_id").agg(F.count("*").alias("n"))


@query(f"""{_RANKED}, p AS (SELECT r.parent_id, is_seed, row_number() OVER (ORDER BY fused_score DESC, r.parent_id) AS pos, text AS content FROM ranked r JOIN documents ON doc_id = r.parent_id),
costs AS (SELECT *, ceil(length(content) / 3.3::DOUBLE)::BIGINT AS cost FROM p), walk AS (SELECT *, sum(cost) OVER (ORDER BY pos) - cost AS before FROM costs),
marked AS (SELECT *, before + cost > 2000 AS over FROM walk), kept AS (SELECT *, count(*) FILTER (WHERE over) OVER (ORDER BY pos) AS overs FROM marked),
cut AS (SELECT *, CASE WHEN over THEN ceil(length(regexp_replace(substr(content, 1, greatest(20, floor(greatest(1, 2000 - before - 9) * 3.3::DOUBLE)::BIGINT)::BIGINT), '\\s+$', '') || '... [truncado pelo orçamento]') / 3.3::DOUBLE)::BIGINT ELSE cost END AS tokens FROM kept WHERE overs = 0 OR (over AND overs = 1 AND (pos = 1 OR 2000 - before >= 59)))
SELECT 20 AS top_k, 80 AS candidate_k, 2000 AS token_budget_limit, 'retrieve' AS mode, 'image,audio' AS source_types, NULL::DOUBLE AS time_from, 1700090000::DOUBLE AS time_to, sum(tokens)::BIGINT AS token_budget_consumed, (SELECT bool_or(over) FROM marked) AS budget_truncated, count(*) AS results_count,
 string_agg(CASE WHEN is_seed THEN 'vector_match' ELSE 'graph_expansion' END, ',' ORDER BY pos) AS retrieval_sources FROM cut""")
def retrieval_trace(spark, d):
    """The trace of the flagship query; its passages are the texts of documents of the same number."""
    texts = D.table(spark, d, "documents").select(F.col("doc_id").alias("parent_id"), F.col("text").alias("content"))
    r = _ranked(spark, d).join(texts, "parent_id").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fused_score"), "parent_id")))  # twenty rows
    r = r.select("rank", "content", F.when(F.col("is_seed"), "vector_match").otherwise("graph_expansion").alias("retrieval_source"))
    filters = retrieval.Filters(source_types=("image", "audio"), time_to=1700090000.0)
    return retrieval.trace(retrieval.budget_cut(r, 2000), TOP, 2000, "retrieve", filters).withColumn("retrieval_sources", F.array_join("retrieval_sources", ","))


@query("""SELECT conv_id, turn, '<evidence rank="' || turn || '" score="' || printf('%.4f', 1.0 / (turn + 2)) || '" section="' || role || '">' || chr(10) || text || chr(10) || '</evidence>' AS block FROM conversations""")
def evidence_block(spark, d):
    c = D.table(spark, d, "conversations")
    return c.select("conv_id", "turn", retrieval.evidence_block(F.col("turn"), F.col("role"), F.lit(1.0) / (F.col("turn") + 2), F.col("text")).alias("block"))
