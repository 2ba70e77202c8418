import json
import random

import pytest
from pyspark.sql import functions as F

from strataloom.functions import vectors
from strataloom.operators import graph, retrieval


@pytest.fixture(scope="module")
def tables(spark):
    children = spark.createDataFrame([("child-1-1", "p1", [0.99, 0.01, 0.0, 0.0]), ("child-2-1", "p2", [0.1, 0.9, 0.0, 0.0]), ("bad", "p3", [0.0, 0.0, 0.0, 0.0]), ("none", "p3", None)], "child_id string, parent_id string, embedding array<float>")
    parents = spark.createDataFrame([("p1", "d1", 1, "document", 1.7e9), ("p2", "d1", 2, "audio", None), ("p3", "d1", 3, "document", 1.8e9)], "parent_id string, document_id string, parent_index int, source_type string, ingested_at double")
    mentions = spark.createDataFrame([("p1", "lgpd"), ("p2", "lgpd"), ("p1", "lei"), ("p2", "lei"), ("p1", "lei"), ("p3", "lei")], "parent_id string, entity_id string")
    entities = spark.createDataFrame([("lgpd", "LGPD", "Regulation"), ("lei", None, "Law")], "entity_id string, name string, label string")
    relations = spark.createDataFrame([("lgpd", "lei", "REGULA"), ("lgpd", "gone", "X")], "source_id string, target_id string, rel_type string")
    documents = spark.createDataFrame([("d1", "doc one")], "document_id string, name string")
    return children, parents, mentions, entities, relations, documents


QUERY = [1.0, 0.0, 0.0, 0.0]


def test_hybrid_and_enrichment(tables):
    children, parents, mentions, entities, relations, documents = tables
    ranked = retrieval.hybrid(children, parents, mentions, QUERY, top_k=3)
    out = {r.parent_id: r for r in retrieval.enriched(ranked, parents, documents, mentions, relations, entities).collect()}
    assert [r.parent_id for r in ranked.collect()] == ["p1", "p3", "p2"]  # p3 by the entity that it shares, p2 as a seed at 0.7 of p1
    first = out["p1"]
    assert first.fused_score > 0.8 and first.retrieval_source == "vector_match" and first.next_chunk_id == "p2" and first.prev_chunk_id is None
    assert first.related_triples == ["LGPD REGULA lei"] and first.document_name == "doc one"
    assert out["p3"].retrieval_source == "graph_expansion"
    assert [(e.type, e.properties) for e in first.entities] == [("Law", '{"id":"lei"}'), ("Regulation", '{"id":"lgpd","name":"LGPD"}')]
    loose = retrieval.neighbours(retrieval.seeds(retrieval.nearest(children, QUERY, 5), parents), mentions)
    bounded = retrieval.neighbours(retrieval.seeds(retrieval.nearest(children, QUERY, 5), parents), mentions, few=True)
    assert sorted(map(tuple, loose.collect())) == sorted(map(tuple, bounded.collect()))
    cut = retrieval.budget_cut(ranked.select(F.when(F.col("parent_id") == "p1", 1).when(F.col("parent_id") == "p3", 2).otherwise(3).alias("rank"), F.repeat(F.lit("x"), 165).alias("content"), F.when(F.col("is_seed"), "vector_match").otherwise("graph_expansion").alias("retrieval_source")), 100)
    t = retrieval.trace(cut, 3, 100, "retrieve", retrieval.Filters(source_types=("audio",), time_from=1.0)).first()
    assert (t.results_count, t.token_budget_consumed, t.budget_truncated, t.candidate_k) == (2, 100, True, 50)
    assert t.retrieval_sources == ["vector_match", "graph_expansion"] and t.source_types == "audio" and t.time_from == 1.0


def test_first_rank_is_the_same_for_any_k(tables):
    children, parents, mentions, *_ = tables
    one, three = (retrieval.hybrid(children, parents, mentions, QUERY, top_k=k).first() for k in (1, 3))
    assert (one.parent_id, one.fused_score) == (three.parent_id, three.fused_score)


def test_filters_follow_the_cut_and_spare_neighbours(tables):
    children, parents, mentions, *_ = tables
    only_audio = retrieval.Filters(source_types=("audio",))
    s = retrieval.seeds(retrieval.nearest(children, QUERY, 1), parents, only_audio)
    assert s.count() == 0
    timed = retrieval.seeds(retrieval.nearest(children, QUERY, 50), parents, retrieval.Filters(time_from=1.0))
    assert [r.parent_id for r in timed.collect()] == ["p1"]
    loose = retrieval.hybrid(children, parents, mentions, QUERY, 5, filters=retrieval.Filters(source_types=("document",)))
    strict = retrieval.hybrid(children, parents, mentions, QUERY, 5, filters=retrieval.Filters(source_types=("document",)), strict_filters=True)
    assert {r.parent_id for r in loose.collect()} == {"p1", "p2", "p3"} and "p2" not in {r.parent_id for r in strict.collect()}


@pytest.mark.parametrize(("k", "want"), [(1, 50), (3, 50), (20, 80)])
def test_candidate_count(k, want):
    assert retrieval.candidate_count(k) == want


def plain_cut(contents, budget):
    cost = lambda t: max(1, -(-len(t) * 10 // 33)) if t else 0
    used, out = 0, []
    for i, c in enumerate(contents):
        if used + cost(c) <= budget:
            out.append(c)
            used += cost(c)
            continue
        if i == 0 or budget - used >= 59:
            out.append(c[: max(20, int(max(1, budget - used - 9) * 3.3))].rstrip() + retrieval.SUFFIX)
        break
    return out


def test_budget_cut(spark):
    rnd, rows, want = random.Random(3), [], {}
    for q in range(60):
        contents = ["".join(rnd.choice("ab  c\n") for _ in range(rnd.choice([0, 5, 100, 600]))) for _ in range(rnd.randrange(1, 7))]
        rows += [(q, i, c) for i, c in enumerate(contents)]
        want[q] = plain_cut(contents, 200)
    got = retrieval.budget_cut(spark.createDataFrame(rows, "q int, rank int, content string"), 200, by=["q"]).orderBy("q", "rank").collect()
    assert {q: [r.content for r in got if r.q == q] for q in want} == want


@pytest.mark.parametrize(("contents", "budget", "n", "truncated"), [(["A" * 600, "B" * 600], 200, 1, True), (["A" * 400, "B" * 600], 200, 2, True), (["A" * 594, "B" * 500], 200, 1, True), (["A" * 990], 50, 1, True), (["A" * 33, "B" * 33], 50, 2, False)])
def test_budget_cases(spark, contents, budget, n, truncated):
    rows = retrieval.budget_cut(spark.createDataFrame(list(enumerate(contents)), "rank int, content string"), budget).orderBy("rank").collect()
    assert len(rows) == n and rows[-1].overflow == truncated
    assert sum(r.tokens for r in rows) <= max(budget, 50 + 9)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0],), ([],)], "v array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("v"), vectors.literal([3.0, 4.0]))).collect()]
    assert abs(got[0] - 1) < 1e-12 and got[1:] == [None] * 4
    e = spark.createDataFrame([("text",), ("text",), ("other",)], "t string").select(vectors.hash_embedding(F.col("t"), 768).alias("e")).collect()
    assert spark.range(1).select(vectors.query_prompt(F.lit("q"))).first()[0] == "task: search result | query: q"
    assert e[0].e == e[1].e != e[2].e and len(e[0].e) == 768 and abs(sum(x * x for x in e[0].e) - 1) < 1e-9


def test_graph_merge(spark):
    schema = "label string, entity_id string, properties map<string,string>, seq long"
    old = spark.createDataFrame([("Law", "a", {"x": "1", "y": "2"}, 1)], schema)
    new = spark.createDataFrame([("Law", "a", {"y": "3"}, 1), ("Law", "a", {"y": "4", "z": "5"}, 2), ("Rule", "b", {}, 1)], schema)
    got = {(r.label, r.entity_id): r.properties for r in graph.merge_nodes(old, new).collect()}
    assert got == {("Law", "a"): {"x": "1", "y": "4", "z": "5"}, ("Rule", "b"): {}}
    edges = spark.createDataFrame([("a", "b", "R", {"k": "1"}, 1), ("a", "b", "R", {"k": "2"}, 2), ("a", "q", "R", {}, 3)], "source_id string, target_id string, rel_type string, properties map<string,string>, seq long")
    edges = edges.unionByName(spark.createDataFrame([("a", "b", "R", {"k": "0", "j": "x", "n": "y"}, 0), ("a", "b", "R", {"n": None}, 4)], edges.schema))
    out = graph.merge_edges(None, edges, new).collect()
    assert [(r.source_id, r.target_id, r.properties) for r in out] == [("a", "b", {"k": "2", "j": "x"})]
    there = spark.createDataFrame([("a", "b", "R", {"k": "old", "since": "1"}, 9), ("q", "z", "R", {}, 1)], edges.schema)
    out = graph.merge_edges(there, edges, new).collect()
    assert {(r.source_id, r.target_id): r.properties for r in out} == {("a", "b"): {"k": "2", "j": "x", "since": "1"}, ("q", "z"): {}}
    nodes, ties = graph.consolidate(new.withColumnRenamed("x", "x"), edges)
    assert nodes.count() == 2 and ties.count() == 2
    assert graph.concat_graphs(edges, edges).count() == 2 * edges.count()
    nodes, ties = graph.consolidate_inline(new, edges)
    assert nodes.count() == 2 and ties.count() == edges.count()


def test_structure(spark):
    p = spark.createDataFrame([("d", "p2", 2, "H2", 7), ("d", "p1", 1, "H1", 5), ("e", "q1", 1, "H", 1)], "document_id string, parent_id string, parent_index int, header_path string, token_count int")
    c = spark.createDataFrame([("d", "p1", "c1", 0, "x"), ("d", "p2", "c2", 1, "y")], "document_id string, parent_id string, child_id string, chunk_index int, content string")
    got = sorted((r.source_id, r.rel_type, r.target_id) for r in graph.structure_edges(p, c).collect())
    assert got == [("d", "HAS_PARENT", "p1"), ("d", "HAS_PARENT", "p2"), ("e", "HAS_PARENT", "q1"), ("p1", "CONTAINS_CHILD", "c1"), ("p1", "NEXT", "p2"), ("p2", "CONTAINS_CHILD", "c2")]
    t = {r.document_id: r for r in graph.chunk_totals(p, c).collect()}
    assert (t["d"].total_parents, t["d"].total_children, t["e"].total_children) == (2, 2, 0)
    assert [tuple(x) for x in t["d"].chunks_summary] == [("p1", "H1", 5), ("p2", "H2", 7)]
    dump = {r.document_id: json.loads(r.value) for r in graph.chunk_dump(p, c).collect()}
    assert [x["parent_id"] for x in dump["d"]["parents"]] == ["p1", "p2"] and [x["content"] for x in dump["d"]["children"]] == ["x", "y"]
    m = spark.createDataFrame([("p1", "a"), ("p9", "a"), ("p1", "z")], "parent_id string, entity_id string")
    assert [tuple(r) for r in graph.known_mentions(m, p, spark.createDataFrame([("a",)], "entity_id string")).select("parent_id", "entity_id").collect()] == [("p1", "a")]


def test_mentions_and_deletion(spark):
    m = graph.mention_rows(spark.createDataFrame([("p1", ["a", "b", "a", " "]), ("p2", [])], "parent_id string, entity_ids array<string>"))
    assert sorted((r.parent_id, r.entity_id) for r in m.collect()) == [("p1", "a"), ("p1", "b")]
    d = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    p = spark.createDataFrame([("p1", "d1"), ("p2", "d2")], "parent_id string, document_id string")
    left = graph.without_document(d, p, p, m, d.filter("document_id = 'd1'"))
    assert [left[k].count() for k in ("documents", "parents", "children", "mentions")] == [1, 1, 1, 0]
    assert [r.entity_id for r in graph.subgraph(spark.createDataFrame([(i, "L") for i in range(9)], "entity_id int, label string")).collect()] == list(range(5))


def test_ask(spark):
    e = spark.createDataFrame([(i, "L") for i in range(9)], "entity_id int, label string")
    assert graph.ask(spark, " select label, count(*) as n from entities group by label", {"entities": e}).first().n == 9
    assert graph.ask(spark, "which laws?", {"entities": e}, 3).count() == 3
    spark.range(3).createOrReplaceTempView("entities")
    asked = graph.ask(spark, "SELECT max(entity_id) AS m FROM entities", {"entities": e})
    assert spark.table("entities").columns == ["id"] and asked.columns == ["m"] and asked.count() == 1
    spark.catalog.dropTempView("entities")
    graph.ask(spark, "SELECT 1 FROM entities", {"entities": e})
    assert not [t for t in spark.catalog.listTables() if t.name == "entities"]


def most_rows(spark, since):
    """The most rows that an operator of a query made, of all queries from number ``since`` on; and the next number."""
    store, most, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    for run in (runs.apply(i) for i in range(runs.size())):
        last = max(last, run.executionId() + 1)
        if run.executionId() >= since:
            names, values = run.metrics(), store.executionMetrics(run.executionId())
            rows = [values.get(m.accumulatorId()) for m in (names.apply(i) for i in range(names.size())) if m.name() == "number of output rows"]
            most = max([most, *(int(v.get().replace(",", "")) for v in rows if v.isDefined())])
    return most, last


@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_queries_make_no_row_for_each_pair_of_parents(spark, kind):
    """All 400 parents are seeds and share an entity: 160,000 pairs. Each has an entity of its own, some two."""
    children = spark.createDataFrame([(i, i, [1.0 if j == i // 40 else 0.001 * (i % 40) for j in range(10)]) for i in range(400)], "child_id long, parent_id long, embedding array<double>")
    parents = children.selectExpr("parent_id", "0L AS document_id", "parent_id AS parent_index", "'document' AS source_type", "0.0D AS ingested_at")
    mentions = parents.selectExpr("parent_id", "1L AS entity_id").union(parents.selectExpr("parent_id", "1000 + parent_id div 2")).union(parents.selectExpr("parent_id", "NULL"))
    queries = spark.createDataFrame([(q, [1.0 if j == q else 0.0 for j in range(10)]) for q in range(10)], "query_id long, vector array<double>")
    _, since = most_rows(spark, 0)
    got = retrieval.hybrid_many(children, parents, mentions.withColumn("entity_id", F.col("entity_id").cast(kind)), queries, top_k=20, candidate_k=40).collect()
    assert most_rows(spark, since)[0] < 20_000
    assert len(got) == 200 and all(r.is_seed for r in got if r["rank"] <= 5)
    n = retrieval.neighbours(parents.selectExpr("parent_id", "1.0D AS seed_score"), mentions)
    want = retrieval.fuse(s := retrieval.seeds(retrieval.vector_index.nearest_many(children, queries, 40), parents, by=["query_id"]), s.join(n.drop("seed_score"), "parent_id"), by=["query_id"])
    held = {(r.query_id, r.parent_id): (r.shared, r.is_seed, round(r.fused_score, 9)) for r in want.collect()}
    assert all(held[r.query_id, r.parent_id] == (r.shared, r.is_seed, round(r.fused_score, 9)) for r in got)


def test_details_of_many_queries_find_the_ranked_rows_once(spark):
    found = spark.sparkContext.accumulator(0)

    def parent(i):
        found.add(1)
        return i

    ranked = spark.range(5, numPartitions=1).select(F.lit(1).alias("query_id"), F.col("id").alias("rank"), F.udf(parent, "long")("id").alias("parent_id"), F.lit(True).alias("is_seed"))
    parents = spark.range(5).selectExpr("id AS parent_id", "0 AS document_id", "id AS parent_index")
    mentions, entities = parents.selectExpr("parent_id", "parent_id AS entity_id"), parents.selectExpr("parent_id AS entity_id", "'n' AS name", "'L' AS label")
    relations = spark.createDataFrame([(0, 1, "R")], "source_id long, target_id long, rel_type string")
    got = retrieval.enriched_many(ranked, parents, spark.createDataFrame([(0, "d")], "document_id int, name string"), mentions, relations, entities).collect()
    assert sorted(r["rank"] for r in got) == list(range(5)) and {r.document_name for r in got} == {"d"}
    assert found.value == 5
