"""Searches by the index against the scan, and what the plan reads."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import search, search_index
from strataloom.storage import shared_folder

DOCS = "doc_id string, doc_pos long, file_name string, markdown string, preview string"
WORDS = ["Architecture", "Storage Láyer", "Índice", "naïve", "ﬁnal", "漢字", "Übersicht", "data", "Aaaa", "ab", "a", "straße", "ARCHITECTURE"]


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(WORDS)
    docs = [(f"d{i}", i, None if i == 3 else f"{word()}-{i % 7}.md", None if i == 4 else "\n".join(rnd.choice([f"# {word()} {word()}", f"##{word()}", "text " + word(), "", "  ### x  "]) for _ in range(rnd.randrange(12))), rnd.choice([None, "", "p" * 300])) for i in range(120)]
    chunks = [(f"d{rnd.randrange(125)}", i, rnd.choice([None, f"Top > ## {word()}", f"# {word()}"])) for i in range(200)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(chunks, "doc_id string, pos int, header_path string")


@pytest.fixture(scope="module")
def index(spark, tables):
    before, search_index.SEGMENT = search_index.SEGMENT, 16
    yield search_index.build(*tables, shared_folder(spark, "search"))
    search_index.SEGMENT = before


QUERIES = ["architecture", "Storage Layer", "storage LÁYER ", "indice", "naive", "final", "漢", "a", "ab", "aaa", "aaaa", "uber", "strasse", "stra", ".md", "-3.md", "top > ##", "", "  ", "nothing at all", "x", "d"]


def test_same_rows(spark, tables, index):
    assert index.segments == 8
    asked = spark.createDataFrame(list(enumerate(QUERIES)) + [(99, None)], "query_id int, query string")
    many = search_index.search_many(spark, index, asked, 10).collect()
    for i, q in enumerate(QUERIES):
        want = [tuple(r) for r in search.quick_search(*tables, q, 10).collect()]
        assert [tuple(r) for r in search_index.quick_search(spark, index, q, 10).collect()] == want, q
        assert [tuple(r)[2:] for r in sorted((r for r in many if r.query_id == i), key=lambda r: r["rank"])] == want, q
    assert not [r for r in many if r.query_id == 99]


def test_limits(spark, tables, index):
    for limit in (1, 3, 50):
        assert [tuple(r) for r in search_index.quick_search(spark, index, "a", limit).collect()] == [tuple(r) for r in search.quick_search(*tables, "a", limit).collect()]
    for limit in (0, 51):
        with pytest.raises(ValueError):
            search_index.quick_search(spark, index, "a", limit)


def test_what_a_search_reads(spark, index):
    """Postings of the query's buckets in some segments, and of entries only those segments'; no stored text."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plan = search_index._candidates(spark, index, "architecture", [0, 1])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    filters = [x.split("PartitionFilters: [")[1].split("PushedFilters")[0] for x in scans]
    assert all("segment" in x for x in filters) and "markdown" not in plan
    postings = [(x, f) for x, f in zip(scans, filters) if "gram#" in x]
    assert postings and all("bucket" in f and "In(gram" in x for x, f in postings)


def test_early_end(spark, index, monkeypatch):
    seen = []
    real = search_index._candidates
    monkeypatch.setattr(search_index, "_candidates", lambda *a: seen.append(a[3]) or real(*a))
    search_index.quick_search(spark, index, "a", 2)
    assert seen == [[0]]
    search_index.quick_search(spark, index, "nothing at all")
    assert seen[1:] == [[0], [1, 2], [3, 4, 5, 6], [7]]


def test_nothing_to_search(spark, tables):
    index = search_index.build(tables[0].filter("false"), tables[1], shared_folder(spark, "search"))
    assert search_index.quick_search(spark, index, "data").count() == 0
    assert search_index.search_many(spark, index, spark.createDataFrame([(1, "data"), (2, "d")], "query_id int, query string")).count() == 0
    assert spark.range(1).select(F.size(search_index.grams_of(F.lit("ab")))).first()[0] == 0


def test_many_queries_for_the_same(spark, tables, index, monkeypatch):
    """Queries that ask for the same, twice or with other accents, and several strings under one number, by either join."""
    rows = [(i, q) for i, q in enumerate(["data", "DATA ", "dáta", "a", "Á", "data"])] + [(0, "data"), (50, "data"), (50, "storage"), (50, "u"), (51, "aaa"), (51, "a")]
    asked = spark.createDataFrame(rows, "query_id int, query string")
    for most in (10_000, 0):
        monkeypatch.setattr(search_index, "MOST_SENT", most)
        many = search_index.search_many(spark, index, asked, 6).collect()
        got = {i: [tuple(r)[1:] for r in sorted((r for r in many if r.query_id == i), key=lambda r: r["rank"])] for i, _ in rows}
        assert got[0] == got[1] == got[2] == got[5] and got[3] == got[4]
        assert [r[1:] for r in got[0]] == [tuple(r) for r in search.quick_search(*tables, "data", 6).collect()]
        assert [r[1:] for r in got[51]] == [r[1:] for r in got[3]]
        assert [r[0] for r in got[50]] == [1, 2, 3, 4, 5, 6] and len({(r[1], r[4]) for r in got[50]}) == 6


def test_only_first_documents_go_on(spark, tables, index):
    """Postings and letters of all entries aren't shuffled for a few queries, nor are all entries that hold a letter."""
    plan = search_index.search_many(spark, index, spark.createDataFrame([(1, "data"), (2, "a")], "query_id int, query string"), 3)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    assert any("WindowGroupLimit" in x and "dense_rank" in x and "Partial" in x for x in lines)
    broadcast = [x for x in lines if "BroadcastHashJoin" in x]
    assert any("gram" in x for x in broadcast) and any("wanted" in x for x in broadcast)
