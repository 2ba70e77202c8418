"""Staged ingestion: what each run touches, what goes wrong where, and the tables in the end."""

import pytest
from pyspark.sql import functions as F

from strataloom import storage
from strataloom.functions import vectors
from strataloom.operators import ingest, markdown, ontology, stages

ONTO = ontology.Ontology("o", 1, (ontology.NodeType("Law"), ontology.NodeType("Court")), (ontology.Relation("RULES", "Court", "Law"),))
FILES = "document_id string, file_name string, content_type string, content binary, ingested_at double"
EMBED = lambda title, text: vectors.hash_embedding(vectors.passage_prompt(title, text), 4)


def files(spark):
    md = lambda k, t: (k, f"{k}.md", "text/markdown", None if t is None else bytearray(t.encode()), 1.7e9)
    return spark.createDataFrame([
        md("a", "# Law\n\nThe court applied the law.\n\n<!-- PAGE 2 -->\n\n# LAW\n\nMore. " * 30), md("b", "Only a law."), md("none", None), md("blank", " \n "), md("bad", "unembeddable court"),
        ("scan", "scan.pdf", "application/pdf", bytearray(b"%PDF"), 1.7e9), ("call", "call.mp3", "audio/mpeg", bytearray(b"ID3"), 1.7e9), ("hum", "hum.mp3", "audio/mpeg", bytearray(b"ID3"), 1.7e9),
    ], FILES)


@pytest.fixture
def root(spark):
    return storage.shared_folder(spark, "stages")


def counts(job, spark):
    return {(r.run, r.step): (r.done, r.failed) for r in job.statuses(spark).groupBy("run", "step").agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed")).collect()}


def test_runs_take_only_what_is_left(spark, root):
    pages = spark.createDataFrame([("scan", 1, "first law"), ("scan", 2, "torn"), ("scan", 3, "third court")], "document_id string, page int, image string")
    segments = spark.createDataFrame([("call.mp3", 0.0, 4.0, "We called."), ("call.mp3", 200.0, 204.0, "The law came.")], "file_name string, start double, end double, text string")
    one = stages.Ingestion(root, ONTO, recognize=lambda c: F.when(c != "torn", F.upper(c)), embed=lambda t, x: F.when(~F.contains(x, F.lit("unembeddable")), EMBED(t, x)))
    one.run(files(spark), 1, pages, segments)
    assert counts(one, spark) == {(1, "PARSING"): (5, 3), (1, "CHUNKING"): (5, 0), (1, "EMBEDDINGS"): (4, 1), (1, "EXTRACTION"): (4, 0), (1, "INDEXING"): (4, 0)}
    assert {r.document_id: (r.step, r.error) for r in one.failures(spark).collect()} == {
        "none": ("PARSING", "no text"), "blank": ("PARSING", "no text"), "scan": ("PARSING", "1 pages not recognized"), "bad": ("EMBEDDINGS", "no embedding"),
    }
    two = stages.Ingestion(root, ONTO, recognize=lambda c: F.lower(c), embed=EMBED)
    two.run(files(spark), 2, pages, segments)
    assert counts(two, spark) | {(2, "PARSING"): (1, 2), (2, "CHUNKING"): (1, 0), (2, "EMBEDDINGS"): (2, 0), (2, "EXTRACTION"): (2, 0), (2, "INDEXING"): (2, 0)} == counts(two, spark)
    # pages that were recognized stay as they are
    assert [r.page for r in spark.read.parquet(f"{root}/pages/run=2").collect()] == [2]
    text = {r.document_id: r.text for r in two.rows(spark, "PARSING").collect()}
    assert text["scan"] == "FIRST LAW\n\ntorn\n\nTHIRD COURT" and text["call"].count("## [") == 2 and "Nenhum áudio" in text["hum"]
    t = two.tables(spark)
    assert {r.document_id for r in t["documents"].collect()} == {"a", "b", "bad", "scan", "call", "hum"} and t["failures"].count() == 2
    assert {r.entity_id for r in t["entities"].collect()} == {"law-1", "court-1"} and t["relations"].count() == 1
    three = counts(two, spark)
    two.run(files(spark), 3, pages, segments)
    assert {k: v for k, v in counts(two, spark).items() if k not in three} == {(3, "PARSING"): (0, 2)}


def test_same_tables_as_in_one_go(spark, root):
    own = files(spark).filter("document_id in ('a', 'b', 'bad', 'none')")
    job = stages.Ingestion(root, ONTO, embed=EMBED)
    job.run(own, 1)
    got, want = job.tables(spark), ingest.ingest(own, ONTO, embed=EMBED)
    for name, columns in {"parents": ["parent_id", "header_path", "content", "token_count"], "children": ["child_id", "parent_id", "chunk_index", "content", "embedding"], "mentions": ["parent_id", "entity_id"], "entities": ["label", "entity_id"]}.items():
        assert sorted(map(str, got[name].select(*columns).collect())) == sorted(map(str, want[name].select(*columns).collect())), name


def test_a_killed_run_is_repeated(spark, root):
    own = files(spark).filter("document_id in ('a', 'b')")
    job = stages.Ingestion(root, ONTO, embed=EMBED)
    job.run(own, 1)
    before = sorted(map(str, job.tables(spark)["children"].collect()))
    storage.remove(spark, f"{root}/status/step=EMBEDDINGS/run=1")  # rows were stored, the statuses not
    for step in ("EXTRACTION", "INDEXING"):
        storage.remove(spark, f"{root}/status/step={step}/run=1")
    job.run(own, 2)
    assert sorted(map(str, job.tables(spark)["children"].collect())) == before
    assert counts(job, spark)[2, "EMBEDDINGS"] == (2, 0) and (2, "PARSING") not in counts(job, spark)


def test_a_model_extracts(spark, root):
    replies = F.when(F.contains(F.col("text"), F.lit("Only")), '{"Law": [{"id": " L9 "}]}').otherwise("no graph")
    job = stages.Ingestion(root, ONTO, embed=EMBED, extract=lambda c: replies)
    job.run(files(spark).filter("document_id in ('a', 'b')"), 1)
    assert {r.entity_id for r in job.tables(spark)["entities"].collect()} == {"l9", "law-1", "court-1"}


def test_families_are_parents_with_their_children(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("n").alias("document_name"), "text")
    family = markdown.family_table(docs)
    assert sorted(map(str, family.drop("children").collect())) == sorted(map(str, markdown.parent_table(docs).collect()))
    own = family.select("document_id", "parent_id", "header_path", F.inline("children"))
    names = ["document_id", "parent_id", "header_path", "child_id", "chunk_index", "content"]
    assert sorted(map(str, own.select(*names).collect())) == sorted(map(str, markdown.child_table(docs).select(*names).collect()))
