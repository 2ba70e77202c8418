"""Nearest chunks by blocks and through the inverted file, against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import retrieval, vector_index
from strataloom.plans import data as D
from strataloom.storage import shared_folder


def plain(children, queries, k):
    """(query_id, rank) -> (child_id, score) by full sorts; vectors are lists."""
    out = {}
    for q, v in queries:
        v = np.asarray(v, dtype=float)
        found = []
        for child, e in children:
            e = np.asarray([] if e is None else e, dtype=float)
            if len(e) == len(v) and np.linalg.norm(e) > 0 and np.linalg.norm(v) > 0:
                found.append((-float(e @ v / np.linalg.norm(e) / np.linalg.norm(v)), child))
        for rank, (s, child) in enumerate(sorted((round(s, 12), c) for s, c in found)[:k], 1):
            out[q, rank] = (child, -s)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 16))
    rows = [(i, i // 5, (centres[i % 12] + 0.4 * rnd.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(5000 + i, 1, rows[i][2]) for i in range(40)]  # copies: ties
    rows += [(6000, 1, None), (6001, 1, []), (6002, 1, [0.0] * 16), (6003, 1, [1.0] * 15)]
    return spark.createDataFrame(rows, "child_id long, parent_id long, embedding array<double>").repartition(5)


@pytest.fixture(scope="module")
def asked(spark, table):
    own = table.filter("child_id % 50 = 0 and child_id < 5000").select(F.col("child_id").alias("query_id"), F.col("embedding").alias("vector"))
    odd = spark.createDataFrame([(-1, None), (-2, []), (-3, [0.0] * 16), (-4, [1.0] * 3)], "query_id long, vector array<double>")
    return own.unionByName(odd)


def rows_of(df):
    return {(r.query_id, r.rank): (r.child_id, r.score) for r in df.collect()}


@pytest.mark.parametrize(("chunks", "queries"), [(32 << 20, 8 << 20), (16 * 4 * 100, 16 * 4 * 7)])
def test_blocks(spark, table, asked, monkeypatch, chunks, queries):
    monkeypatch.setattr(vector_index, "CHUNK_BYTES", chunks)
    monkeypatch.setattr(vector_index, "QUERY_BYTES", queries)
    got = rows_of(vector_index.nearest_many(table, asked, 7))
    want = plain([(r.child_id, r.embedding) for r in table.collect()], [(r.query_id, r.vector) for r in asked.collect() if r.query_id >= 0], 7)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_blocks_of_nothing(spark, table, asked):
    assert vector_index.nearest_many(table.filter("false"), asked, 5).count() == 0
    assert vector_index.nearest_many(table, asked.filter("false"), 5).count() == 0


def test_index(spark, table, asked):
    index = vector_index.build(table, shared_folder(spark, "index"), k=20)
    assert index == vector_index.opened(spark, index.path)
    centres = index.centres(spark).collect()
    assert sum(r.rows for r in centres) == 3040 == index.vectors(spark).count()  # every row that has a vector
    exact = rows_of(vector_index.nearest_many(table, asked, 20))
    got = rows_of(vector_index.nearest_many_indexed(spark, index, asked, 20))
    of = lambda rows: {(q, c) for (q, _), (c, _) in rows.items()}
    assert len(of(exact) & of(got)) >= 0.9 * len(of(exact))
    # clustered vectors: few lists are read, and the plan reads only their folders
    vector = table.filter("child_id = 100").first().embedding
    found, read = vector_index.nearest(spark, index, vector, 20)
    assert read < 1500 and "PartitionFilters: [list" in found._jdf.queryExecution().executedPlan().toString()
    sure, read_all = vector_index.nearest(spark, index, vector, 20, exact=True)
    assert read <= read_all <= 3040
    assert [r.child_id for r in sure.collect()] == [c for (q, _), (c, _) in sorted(exact.items()) if q == 100]
    # filters follow the cut, as without an index
    parents = spark.range(700).select(F.col("id").alias("parent_id"), F.lit("image").alias("source_type"), F.lit(0.0).alias("ingested_at"), F.col("id").alias("document_id"))
    assert retrieval.seeds(sure, parents, retrieval.Filters(source_types=("audio",))).count() == 0
    for odd in ([], [0.0] * 16, [1.0] * 3):
        none, nothing = vector_index.nearest(spark, index, odd, 5, exact=True)
        assert none.count() == 0 and nothing == 0


def test_pieces_of_a_list(spark, table, asked, monkeypatch):
    index = vector_index.build(table, shared_folder(spark, "index"), k=20, lists=3)
    whole = rows_of(vector_index.nearest_many_indexed(spark, index, asked, 9, probes=2))
    monkeypatch.setattr(vector_index, "CHUNK_BYTES", 16 * 4 * 50)
    assert rows_of(vector_index.nearest_many_indexed(spark, index, asked, 9, probes=2)) == whole
    assert rows_of(vector_index.nearest_many_indexed(spark, index, asked, 9, probes=3)) == rows_of(vector_index.nearest_many(table, asked, 9))


def test_index_of_nothing(spark, table, asked):
    index = vector_index.build(table.filter("false"), shared_folder(spark, "index"))
    assert vector_index.nearest(spark, index, [1.0] * 16, 5, exact=True)[0].count() == 0
    assert vector_index.nearest_many_indexed(spark, index, asked, 5).count() == 0


def test_recall_on_the_given_vectors(spark):
    """The vectors of the tables have hardly any clusters, so many lists are read; the share found is measured at 50."""
    sf = "/root/testdata/sf0.1"
    children, queries = D.children(spark, sf), D.query_vectors(spark, sf)
    exact = {(r.query_id, r.child_id) for r in vector_index.nearest_many(children, queries, 50).collect()}
    index = vector_index.build(children, shared_folder(spark, "index"), k=50)
    got = {(r.query_id, r.child_id) for r in vector_index.nearest_many_indexed(spark, index, queries, 50).collect()}
    assert len(exact) == 40 * 50 and len(exact & got) >= 0.9 * len(exact)
    assert index.probes < index.centres(spark).count()


def test_hybrid_many_is_hybrid(spark, small):
    p, m, c = D.parents(spark, small), D.mentions(spark, small), D.children(spark, small)
    queries = D.query_vectors(spark, small).limit(3)
    many = retrieval.hybrid_many(c, p, m, queries, top_k=5, filters=retrieval.Filters(source_types=("image", "audio")), strict_filters=True).collect()
    for q in queries.collect():
        one = retrieval.hybrid(c, p, m, list(q.vector), top_k=5, filters=retrieval.Filters(source_types=("image", "audio")), strict_filters=True).collect()
        mine = sorted((r for r in many if r.query_id == q.query_id), key=lambda r: r["rank"])
        assert [(r.parent_id, r.shared, r.is_seed, round(r.fused_score, 9)) for r in mine] == [(r.parent_id, r.shared, r.is_seed, round(r.fused_score, 9)) for r in one]
