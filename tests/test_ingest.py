import pytest
from pyspark.sql import functions as F

from strataloom.functions import models
from strataloom.functions import text as T
from strataloom.operators import graph, ingest, lifecycle, ontology
from strataloom.sources import files as files_

ONTO = ontology.Ontology("o", 1, (ontology.NodeType("Law"), ontology.NodeType("Court")), (ontology.Relation("RULES", "Court", "Law"),))


def files(spark):
    rows = [("a", "a.md", "text/markdown", b"# Law\n\nThe court reads the law.", 1.0), ("b", "b.txt", None, "é law".encode("latin-1"), None), ("c", "c.bin", None, b"  ", 2.0), ("d", "d.ogg", None, b"sound", 3.0)]
    return spark.createDataFrame(rows, "document_id string, file_name string, content_type string, content binary, ingested_at double")


def test_ingest(spark):
    out = ingest.ingest(files(spark), ONTO, parsers={"audio": lambda c: F.lit("heard the court")}, dimensions=4)
    assert {r.document_id: r.source_type for r in out["documents"].collect()} == {"a": "document", "b": "document", "d": "audio"}
    assert [(r.document_id, r.step) for r in out["failures"].collect()] == [("c", "PARSING")]
    assert {r.content for r in out["parents"].collect()} == {"# Law\n\nThe court reads the law.", "é law", "heard the court"}
    assert all(len(r.embedding) == 4 for r in out["children"].collect())
    assert sorted(r.label for r in out["entities"].collect()) == ["Court", "Law"] and out["relations"].count() == 1 and out["mentions"].count() == 4
    again = ingest.ingest(files(spark), ONTO, done=files(spark).filter("document_id in ('a', 'b', 'c')"))
    assert [r.document_id for r in again["documents"].collect()] == ["d"]


def test_source_types(spark):
    cases = [("x.PNG", None, "image"), ("x.png", "text/plain", "document"), ("x.bin", " Video/3GPP ", "audio"), ("x.mp3", "application/octet-stream", "audio"), (".mp3", None, "document"), ("a.tar.webm", "", "audio"), (None, None, "document")]
    df = spark.createDataFrame([c[:2] for c in cases], "n string, m string").select(T.source_type(F.col("m"), F.col("n")))
    assert [r[0] for r in df.collect()] == [c[2] for c in cases]


def test_loose_records(spark):
    e = spark.createDataFrame([("x", "", "Sig", "", "T", ["a"]), (" ", "n", None, "E", None, None), ("y", None, None, None, None, None)], "id string, name string, sigla string, entity_type string, type string, aliases array<string>")
    assert [tuple(r) for r in ingest.entity_rows(e).collect()] == [("x", "Sig", "T", ["a"], {"sigla": "Sig"}), ("y", "y", "", [], {})]
    e = spark.createDataFrame([("x", "N", {"a": "1", "sigla": "old", "b": "2"}, "new", 7, None)], "id string, name string, properties map<string,string>, sigla string, year int, note string")
    assert ingest.entity_rows(e).first().properties == {"a": "1", "b": "2", "sigla": "new", "year": "7"}
    r = spark.createDataFrame([("a", None, "", "R")], "source_id string, target_id string, type string, name string")
    assert tuple(ingest.relation_rows(r).first()) == ("a", "", "R")
    items = spark.createDataFrame([("Chapter", "##", " T ", 99), ("odd", "#", "x", None), ("table", "#####", "x", 1), ("table", "#", " ", 1)], "type string, markdown_level string, title string, page int")
    assert [(r.type, r.title, r.page) for r in ingest.toc_rows(items, 26, 50).collect()] == [("chapter", "T", 50), ("section", "x", 26)]


def test_answers(spark):
    df = spark.createDataFrame([(0,), (3,)], "n long")
    assert [r[0] for r in df.select(ingest.answer(F.col("n"), "none")).collect()] == [ingest.NOTHING_FOUND, ingest.NO_SYNTHESIS % 3]
    assert df.select(ingest.answer(F.col("n"), "synthesis", F.lit("model"))).collect()[1][0] == "model"
    one = spark.range(1)
    assert one.select(T.json_part(F.lit("text ```json\n[1, [2]]\n``` end, see [3]."))).first()[0] == "[1, [2]]"
    assert one.select(T.utc_time(F.lit(None).cast("double"))).first()[0] == "N/A"
    toc = ingest.content_with_headings(spark.createDataFrame([("d", "# A\n\n## B")], "document_id string, text string")).first().toc
    assert [(h.level, h.title) for h in toc] == [(1, "A"), (2, "B")]


def test_contents_fall_back_to_the_log(spark):
    stored = spark.createDataFrame([("a", "text")], "document_id string, text string")
    log = spark.createDataFrame([("a", "DocumentParsedToMarkdown", 1, "p"), ("b", "DocumentParsedToMarkdown", 1, "old"), ("b", "DocumentParsedToMarkdown", 2, "new"), ("c", "DocumentStored", 1, None)], "aggregate_id string, event_type string, event_version int, markdown_preview string")
    assert {r.document_id: r.text for r in ingest.content_or_log(stored, log).collect()} == {"a": "text", "b": "new"}


def test_extraction_with_a_model(spark):
    onto = ontology.Ontology("o", 1, (ontology.NodeType("Law", (ontology.Property("level", values=("federal", "state")),)), ontology.NodeType("Court")), (ontology.Relation("RULES", "Court", "Law"),))
    replies = {"good": '```json {"Law": [{"id": "l1", "level": "state"}, {"id": " "}], "RULES": [{"source_id": "c", "target_id": "l1"}]} ```', "odd": '{"Law": [{"id": "l2", "level": "city"}]}'}
    p = spark.createDataFrame([("1", "good"), ("2", "odd"), ("3", "the court and a law")], "parent_id string, text string")
    model = F.udf(lambda t: replies.get(t, "no json"))
    graphs = {r.parent_id: r.graph for r in ontology.parse_graphs(p.withColumn("reply", model("text")), onto).collect()}
    assert graphs["1"].Law[0].level == "state" and graphs["2"].Law[0].level is None and graphs["3"] is None
    nodes, edges = ontology.extract_with(p, onto, model)
    assert sorted(tuple(r) for r in nodes.collect()) == [("1", "l1", "Law", {"level": "state", "name": "l1"}), ("2", "l2", "Law", {"name": "l2"}), ("3", "court-1", "Court", {}), ("3", "law-1", "Law", {})]
    assert [tuple(r) for r in edges.collect()] == [("3", "court-1", "law-1", "RULES", {})]  # the other one's court is no node
    bare = ontology.Ontology("bare", 1, (ontology.NodeType("Law"),))
    assert ontology.extract_with(p, bare, model)[1].count() == 0 and ontology.extract(p, ontology.Ontology("none"))[0].count() == 0
    made = ingest.merged_graph(p, *ontology.extract_with(p, onto, model))
    assert [t.count() for t in made] == [4, 1, 4]
    have = spark.createDataFrame([("a", 1)], "name string, version int")
    assert [tuple(r) for r in ontology.new_versions(have, spark.createDataFrame([("a", 1), ("a", 2), ("A", 1)], have.schema)).orderBy("name").collect()] == [("A", 1), ("a", 2)]


def test_models_in_batches(spark):
    def make():
        tries = []

        def model(texts):
            tries.append(len(texts))
            if len(tries) == 1:
                raise models.Refused(0.1)
            return [f"{len(texts)}:{t}" for t in texts]

        return model

    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(7)], "i int, t string").coalesce(1)
    got = [r[1] for r in df.select("i", models.batched(make, "string", size=4)(F.col("t"))).orderBy("i").collect()]
    assert got == ["4:t0", "4:t1", "4:t2", None, "4:t4", "2:t5", "2:t6"]


def test_limiter_and_waits():
    clock = [0.0]
    limit = models.Limiter(2, 100, 60, now=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s))
    for tokens in (40, 40):
        limit.acquire(tokens)
    assert clock[0] == 0
    limit.acquire(10)
    assert 60 <= clock[0] < 60.1 and len(limit.admitted) == 1
    limit.acquire(1000)  # more than the limit counts as the limit, so waits for an empty window
    assert clock[0] >= 120 and [n for _, n in limit.admitted] == [100]
    assert models.wait_of(3, 0.01) == 0.1 and 8 <= models.wait_of(3, None) <= 12 and models.wait_of(9, None) <= 45
    with pytest.raises(models.Refused):
        models.with_retries(lambda: (_ for _ in ()).throw(models.Refused()), tries=2, sleep=lambda s: None)()


def test_page_checkpoints(spark):
    paths = spark.createDataFrame([("d", "kb/ocr_cache/d/page_0001.md"), ("d", "kb/ocr_cache/d/page_0002.md"), ("d", "x/page_0002.md"), ("e", "page_0009.md"), ("e", "other.md")], "document_id string, path string")
    docs = spark.createDataFrame([("d", 2), ("e", 1), ("f", 0)], "document_id string, n_pages int")
    assert sorted((r.document_id, r.completed, r.complete) for r in files_.completed_pages(paths, docs).collect()) == [("d", 2, True), ("e", 0, False), ("f", 0, True)]
    assert spark.range(1).select(files_.page_name(F.lit(7)), files_.part_name(F.lit("a/b:c"))).first()[:] == ("page_0007.md", "a_b_c.json")
    done = spark.createDataFrame([("d", 1, "one")], "document_id string, page int, markdown string")
    assert [tuple(r) for r in files_.missing_pages(docs, done).orderBy("document_id").collect()] == [("d", 2), ("e", 1)]
    pages = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y"), ("e", 1, None)], "document_id string, page int, image string")
    assert sorted(tuple(r) for r in files_.recognize(pages, done, lambda c: F.upper(c)).collect()) == [("d", 1, "one"), ("d", 2, "Y")]
    found = spark.createDataFrame([("a",)], "path string")
    assert [r.there for r in files_.exist(spark.createDataFrame([("a",), ("b",)], "path string"), found).orderBy("path").collect()] == [True, False]


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.appended(F.lit(None).cast("string"), F.lit("1"))) == "[1]" and one(T.appended(F.lit("[1, 2]"), F.lit('"x"'))) == '[1, 2,"x"]'
    assert one(T.words_and_margin(F.lit(" a  b "))) == 502 and one(T.payload_tokens(F.lit(None).cast("binary"))) == 100 and one(T.payload_tokens(F.encode(F.lit("abcdefgh"), "utf-8"))) == 2
    v = F.parse_json(F.lit('{"a": {"b": 3}}'))
    assert one(T.field_or(v, "$.a.b", "int")) == 3 and one(T.field_or(v, "$.c", "int", 9)) == 9 and one(T.field_or(v, "$.c", "int")) is None
    assert one(T.snippets(F.array(F.lit("x" * 300), F.lit("y")))) == "- " + "x" * 200 + "\n- y"
    assert one(T.suffix(F.lit("a/b.c/d"))) == "" and one(T.suffix(F.lit("x.TAR.Gz"))) == ".gz"


def test_deletions(spark, tmp_path):
    for name in ("kb/raw/d1-a.md", "kb/raw/d12-b.md", "kb/raw/d2.md", "kb/processed/d1/x.md", "kb/odd[1].md", "kb/odd1.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    at = f"file://{tmp_path}"
    prefixes = spark.range(1).select(files_.document_prefixes(F.lit("kb"), F.lit("d1-"))).first()[0]
    assert prefixes == ["kb/raw/d1-", "kb/processed/d1-", "kb/checkpoints/d1-"]
    assert [files_.delete_prefix(spark, at, p) for p in prefixes] == [1, 0, 0] and files_.delete_prefix(spark, at, "kb/processed/d1") == 1
    assert files_.delete_prefix(spark, at, "kb/odd[1]") == 1 and (tmp_path / "kb/odd1.md").exists() and (tmp_path / "kb/raw/d12-b.md").exists()
    for bad in ("", "../x", "kb/../../x"):
        with pytest.raises(ValueError):
            files_.delete_prefix(spark, at, bad)
    docs = spark.createDataFrame([("k1", "a"), ("k2", "b")], "kb_id string, document_id string")
    parents = spark.createDataFrame([("a", "a1"), ("b", "b1")], "document_id string, parent_id string")
    mentions = spark.createDataFrame([("a1", "e"), ("b1", "e")], "parent_id string, entity_id string")
    own = spark.createDataFrame([("k1", "e"), ("k2", "e")], "kb_id string, entity_id string")
    left = graph.without_base(docs, parents, parents, mentions, own, own, spark.createDataFrame([("k1",)], "kb_id string"))
    assert {k: v.count() for k, v in left.items()} == dict.fromkeys(("documents", "parents", "children", "mentions", "entities", "relations"), 1)
    src = spark.createDataFrame([("s",), ("t",)], "source_id string")
    assert [[r.source_id for r in x.collect()] for x in lifecycle.without_sources(src, src, src, src.filter("source_id = 's'"))] == [["t"]] * 3
