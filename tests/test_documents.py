import hashlib
import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import ingest, markdown, ontology, quality, search, toc
from strataloom.operators import markdown as M
from strataloom.plans import document_queries
from strataloom.sources import files, html


def kinds(text):
    return [b.kind for b in M.blocks(text)]


def test_blocks():
    assert M.blocks("") == [] and M.blocks(" \n\t\n") == []
    assert [b.level for b in M.blocks("# A\n## B\n### C")] == [1, 2, 3]
    assert kinds("para\n\n```py\n# no heading\n\n| x |\n```\nmore") == [M.PARAGRAPH, M.CODE, M.PARAGRAPH]
    assert kinds("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |") == [M.TABLE]
    assert kinds("> quote\n> more\n\n- a\n- b\n\n1. one\n2. two") == [M.QUOTE, M.LIST, M.LIST]
    assert kinds("one\n\n---\n\ntwo") == [M.PARAGRAPH, M.BREAK, M.PARAGRAPH]
    assert kinds("# T\n## S\ntext\n- item\ngoes on\n```\ncode\n```\n| t |") == [M.HEADING, M.HEADING, M.PARAGRAPH, M.LIST, M.PARAGRAPH, M.CODE, M.TABLE]
    assert kinds("~~~\n```\nstill code") == [M.CODE]
    assert kinds("```\na\n```\n```\nb\n```") == [M.CODE, M.CODE]


def test_parents():
    assert M.parents("x.md", []) == []
    small = M.parents("small.md", M.blocks("# Overview\n\nText."))
    assert [(p.index, p.header_path) for p in small] == [(1, "[Doc: small.md] > # Overview")]
    plain = M.parents("p", M.blocks("\n\n".join(["word " * 20] * 5)), M.Limits(parent_tokens=30))
    assert [p.header_path for p in plain] == [f"[Doc: p] > Part {k}" for k in range(1, 6)]
    # the heading that closes a parent is already in that parent's path
    late = M.parents("d", M.blocks("# A\n\n" + "x" * 200 + "\n\n## B\n\nmore"), M.Limits(parent_tokens=51))
    assert late[0].header_path == "[Doc: d] > # A > ## B"
    table = "| a | b |\n" + "| 1 | 2 |\n" * 10
    assert any(table.strip() == p.content for p in M.parents("t", M.blocks("text here\n\n" + table), M.Limits(parent_tokens=28)))
    split = M.parents("s", M.blocks("First sentence is here. Second sentence is here! Third one? Fourth sentence ends."), M.Limits(parent_tokens=10))
    assert len(split) > 1 and [p.part for p in split] == list(range(1, len(split) + 1)) and "Third one?" in " ".join(p.content for p in split)


def test_splits_lose_no_words():
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice(["word", " ", " ", ". ", "\n", "! ", "longerword"]) for _ in range(rnd.randrange(1, 120))).strip()
        if not text:
            continue
        limits = M.Limits(parent_tokens=rnd.choice([3, 8, 20]), child_tokens=rnd.choice([2, 5]), overlap_tokens=rnd.choice([0, 2]))
        parts = M.split_block(text, limits)
        assert " ".join(" ".join(parts).split()) == " ".join(text.split())
        have = " ".join(M.children(text, limits)).split()
        for w in set(text.split()):
            assert w in have


def test_child_overlap():
    text = " ".join(f"Sentence number {i} is here." for i in range(20))
    chunks = M.children(text, M.Limits(child_tokens=20, overlap_tokens=8))
    assert len(chunks) > 3
    for a, b in zip(chunks, chunks[1:]):
        assert b.startswith(a.split(". ")[-1].rstrip("."))


def test_chunk_tables(spark):
    docs = spark.createDataFrame([("a", "a.md", "# T\n\n" + "One. Two. " * 300, "document", 1.0), ("b", "b.md", "", "audio", None), ("c", "c.md", None, None, None)], "document_id string, document_name string, text string, source_type string, ingested_at double")
    p, c = M.parent_table(docs).collect(), M.child_table(docs).collect()
    assert {r.document_id for r in p} == {"a"} and p[0].parent_id == "a-p1" and p[0].source_type == "document" and p[0].ingested_at == 1.0
    assert sorted(r.chunk_index for r in c) == list(range(len(c)))
    assert M.block_table(docs.select("document_id", "text")).count() == 2


@pytest.mark.parametrize(
    ("text", "want"),
    [("## Intro\n\n## Intro\n\nSome content", "## Intro\n\nSome content"), ("## Intro\n\n## Methods\n\nC", "## Intro\n\n## Methods\n\nC"), ("## I\n\nText.\n\n## I\n\nMore", "## I\n\nText.\n\n## I\n\nMore"), ("## INTRO\n\n## Intro\n\nC", "## INTRO\n\nC"), ("# Intro\n<!--PAGE 3-->\n\n### intro \nC", "# Intro\nC"), ("# A\n<!-- note -->\n# A", "# A\n<!-- note -->\n# A"), ("# A\n\n# A\n# a\n\n", "# A\n"), ("", "")],
)
def test_repeated_headings(text, want):
    assert M.drop_repeated_headings(text) == want


def test_clean_markdown(spark):
    t = "<!-- PAGE 1 -->\n\nOne.\n\n\n\n\n<!-- [Erro no OCR da Página 3:\ntimeout] -->\n\nTwo | x |\n\n<!-- PAGE 12 -->"
    got = spark.createDataFrame([(t,)], "t string").select(T.clean_markdown(F.col("t"))).first()[0]
    assert got == "One.\n\nTwo | x |"
    t = "<!--PAGE 1-->\n# T\n\n<!--  PAGE  2 -->\n## t\n<!--  [Erro no OCR x] -->\nBody\n\n\n\n# U\n# u\n"
    got = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(M.normalized(F.col("t"))).collect()
    assert [r[0] for r in got] == ["# T\n\nBody\n\n# U", None, ""]


def test_audio():
    got = M.audio_blocks([(0, 30, "a"), (30.5, 75, "b"), (130, 150, "c"), (151, 152, "  ")])
    assert got == [(0, 75, "a b"), (130, 150, "c")]
    assert M.audio_blocks([]) == []


def test_text_functions(spark):
    df = spark.createDataFrame([("", None), ("abc", "image/png"), ("x" * 9, "AUDIO/mp3")], "t string, m string")
    assert [r[0] for r in df.select(T.chunk_tokens(F.col("t"))).collect()] == [0, 1, 2]
    assert [r[0] for r in df.select(T.budget_tokens(F.col("t"))).collect()] == [0, 1, 3]
    assert [r[0] for r in df.select(T.source_type(F.col("m"), F.lit("a.HEIC"))).collect()] == ["image", "image", "audio"]
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(T.anchor(F.lit("  Ação & Reação -- 1.1 "))) == "acao-reacao-11" and pick(T.anchor(F.lit("漢字"))) == "section"
    assert pick(T.fold(F.lit("Índice"))) == "indice"
    assert pick(T.header_title(F.lit("[Doc: x] > # A > ## 1.1 Storage Layer"))) == "1.1 Storage Layer"
    assert pick(T.identifier(F.lit(""))) == "Entity" and pick(T.identifier(F.lit("has-part x"), upper=True)) == "HAS_PART_X"
    assert pick(T.clock(F.lit(6005.9))) == "100:05" and pick(T.clock(F.lit(75.0))) == "01:15"
    assert pick(T.snake_case(F.lit("DocumentParsedToMarkdown"))) == "document_parsed_to_markdown"
    assert pick(T.field_name(F.lit("1st-name"))) == "Field_1st_name" and pick(T.graph_name(F.lit("a-b"))) == "kb_a_b"
    assert pick(T.base_name(F.lit("a/b\\c.txt"))) == "c.txt"
    assert pick(F.size(T.headings(F.lit("# A\n x\n####### no\n ## B ")))) == 2


def test_quick_search(spark):
    docs = spark.createDataFrame([("d1", 1, "Architecture.md", "# Intro\n## 1.1 Storage Layer\n"), ("d2", 2, "other.md", "# Storage Layer")], "doc_id string, doc_pos int, file_name string, markdown string")
    chunks = spark.createDataFrame([("d1", 0, "[Doc: a] > # Intro > ## 1.1 Storage Layer")], "doc_id string, pos int, header_path string")
    assert [(r.match_type, r.title) for r in search.quick_search(docs, chunks, " ARCHITECTURE ").collect()] == [("title", "Architecture.md")]
    hits = search.quick_search(docs, chunks, "Storage Láyer").collect()
    assert [(r.doc_id, r.title, r.anchor) for r in hits] == [("d1", "1.1 Storage Layer", "11-storage-layer"), ("d2", "Storage Layer", "storage-layer")]
    assert search.quick_search(docs, chunks, "漢").count() == 0 and search.quick_search(docs, chunks, "storage", 1).count() == 1


def test_ontology(spark):
    o = ontology.Ontology("legal", 1, (ontology.NodeType("Law", (ontology.Property("year", "integer", True), ontology.Property("kind", values=("a", "b")))), ontology.NodeType("Court")), (ontology.Relation("RULES", "Court", "Law"),))
    assert o.problems() == []
    bad = ontology.Ontology(" ", 0, (ontology.NodeType("A"), ontology.NodeType("A")), (ontology.Relation("R", "A", "B"),))
    assert len(bad.problems()) == 4
    replies = spark.createDataFrame([('```json\n{"Law": [{"id": "l", "year": 1990}], "RULES": [{"source_id": "c", "target_id": "l"}]}\n```',), ("no json",)], "reply string")
    got = ontology.parse_graphs(replies, o).collect()
    assert got[0].graph.Law[0].year == 1990 and got[0].graph.RULES[0].target_id == "l" and got[1].graph is None
    n, e = ontology.extract(spark.createDataFrame([("p", "The COURT applied the law."), ("q", "a lawyer")], "parent_id string, text string"), o)
    assert sorted((r.parent_id, r.label) for r in n.collect()) == [("p", "Court"), ("p", "Law"), ("q", "Law")] and e.count() == 1
    q = ontology.quality(spark.createDataFrame([(1, "a", "Law"), (1, "b", "X")], "graph_id int, entity_id string, label string"), spark.createDataFrame([(1, "a", "b"), (1, "a", "z"), (2, "a", "b")], "graph_id int, source_id string, target_id string"), ["Law"])
    assert {r.graph_id: (r.integrity, r.adherence) for r in q.collect()} == {1: (50.0, 50.0), 2: (0.0, 0.0)}


TOC = [(0, 1, "Title", 1), (1, 2, "1. Intro", 1), (2, 2, "2. Methods", 2), (3, 3, "2.2 Inclusion Criteria", 2), (4, 4, "detail", 3), (5, 2, "3. Discussion", 6)]


def test_sections_that_are_open_at_a_page(spark):
    items = spark.createDataFrame([("d", *r) for r in TOC] + [("e", 0, 2, "late", 4)], "doc_id string, pos int, level int, title string, page int")
    pages = spark.createDataFrame([("d", 4), ("d", 6), ("d", 1), ("e", 3), ("e", 4), ("f", 1)], "doc_id string, page int")
    got = {(r.doc_id, r.page): r.lineage for r in toc.hierarchy(items, pages).collect()}
    assert got[("d", 4)] == "# Title -> ## 2. Methods -> ### 2.2 Inclusion Criteria -> #### detail" and got[("d", 6)] == "# Title -> ## 3. Discussion"
    assert got[("d", 1)] == "# Title -> ## 1. Intro" and got[("e", 4)] == "## late" and got[("e", 3)] == got[("f", 1)] == toc.NOTHING_OPEN
    text = toc.contents_list(items).filter("doc_id = 'd'").first().text
    assert text == "# Índice / Table of Contents\n\n- [1. Intro](#pág-1)\n- [2. Methods](#pág-2)\n  - [2.2 Inclusion Criteria](#pág-2)\n    - [detail](#pág-3)\n- [3. Discussion](#pág-6)"


def test_sections_carried_over_batches(spark):
    items = spark.createDataFrame([("d", *r) for r in TOC], "doc_id string, pos int, level int, title string, page int")
    rows = toc.batch_states(items, spark.createDataFrame([("d", 7), ("e", 0)], "doc_id string, n_pages int"), 3).orderBy("batch")
    assert [tuple(r)[1:] for r in rows.collect()] == [(0, 1, 3, None, None, None), (1, 4, 6, "2. Methods", "2.2 Inclusion Criteria", "####"), (2, 7, 7, "3. Discussion", None, "##")]
    shown = rows.select(toc.state_text(F.col("first_page"), F.col("section"), F.col("subsection"), F.col("level"))).collect()
    assert shown[0][0] == "Estado prévio: " + toc.NOTHING_OPEN and "Página 6:\n- Seção Principal Ativa (##): 3. Discussion\n- Subseção Ativa (###): Nenhuma\n- Nível Ativo: ##" in shown[2][0]


def test_ocr_quality(spark):
    full = "# Head\n| a | b |\n| --- | --- |\n| 1 | 2 |\nkey\n> **[Figura 1]** Descrição visual: x"
    s = lambda *x: list(x)
    rows = [(1, full, s("A", "b"), s("head"), s("KEY", "no"), True), (2, "a key", s("a", "b"), [], None, False), (3, "x", [], [], [], False), (4, None, [], s("h"), [], True), (5, "[figura 7]", [], [], [], True)]
    df = spark.createDataFrame(rows, "id int, text string, columns array<string>, headings array<string>, keywords array<string>, has_figure boolean")
    got = {r.id: (r.score_tables, r.score_headings, r.score_keywords, r.score_figures, round(r.quality, 6)) for r in quality.ocr_scores(df).collect()}
    assert got[1] == (100, 100, 50, 100, round((35 + 25 + 12.5 + 35) / 1.2, 6))
    assert got[2] == (20, 100, 100, 100, 20) and got[3] == (100, 100, 100, 100, 100)
    assert got[4] == (100, 0, 100, 0, 0) and got[5][3:] == (50, 50)
    assert spark.range(1).select(quality.cost_of_thousand(F.lit(1000), F.lit(500), F.lit(0.2), F.lit(0.4))).first()[0] == pytest.approx(0.4)
    runs = spark.createDataFrame([("m", 50.0, 10.0, 1.0), ("m", 100.0, 30.0, 3.0), ("n", 80.0, 5.0, 1.0)], "model string, quality double, latency_ms double, cost_of_thousand double")
    assert [tuple(r) for r in quality.model_means(runs).collect()] == [("n", 1, 80.0, 5.0, 1.0), ("m", 2, 75.0, 20.0, 2.0)]


def test_files_that_need_no_model(spark):
    rows = [("a.csv", None, b"x,y\n1,\"a|b\"\n3\n"), ("b", "text/html", b"<h1>T</h1><p>x"), ("c.json", None, b'{"k": 1}'), ("d.TXT", "text/html", "é <b>".encode("latin-1")), ("e.csv", None, b""), ("f.md", None, None)]
    got = {r.file_name: r.text for r in html.fast_texts(spark.createDataFrame(rows, "file_name string, content_type string, content binary")).collect()}
    assert got == {"a.csv": "| x | y |\n| --- | --- |\n| 1 | a\\|b |\n| 3 |  |", "b": "# T\n\nx", "c.json": '{"k": 1}', "d.TXT": "é <b>", "e.csv": "", "f.md": None}
    ending = lambda m, n: spark.range(1).select(T.ending_of(F.lit(m), F.lit(n))).first()[0]
    assert ending("Text/CSV", "x") == ".csv" and ending("text/csv", "a.PDF") == ".pdf" and ending("image/png", ".hidden") == ".txt" and ending(None, None) == ".txt"
    assert ending("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "") == ".docx"


# The queries over notes against plain code.


def notes(spark, small):
    return {r.document_id: r for r in document_queries._notes(spark, small).collect()}


def test_chunk_queries(spark, small):
    source = notes(spark, small)
    limits = markdown.Limits(parent_tokens=400)
    parents = sorted((r.document_id, r.parent_index, r.header_path, r.content, r.token_count) for r in document_queries.parent_chunks(spark, small).collect())
    assert parents == sorted((str(k), p.index, p.header_path, p.content, p.tokens) for k, n in source.items() for p in markdown.parents(n.document_name, markdown.blocks(n.text, limits), limits))
    children = document_queries.child_chunks(spark, small).collect()
    want = {(str(k), i): c for k, n in source.items() for i, c in enumerate(c for p in markdown.parents(n.document_name, markdown.blocks(n.text)) for c in markdown.children(p.content))}
    assert {(r.document_id, r.chunk_index): r.content for r in children} == want
    by_sql = document_queries.child_chunks_sql(spark, small)
    names = ["parent_id", "child_id", "chunk_index", "header_path", "content", "source_type", "ingested_at"]
    assert sorted(map(str, by_sql.select(*names).collect())) == sorted(str(r) for r in document_queries.child_chunks(spark, small).select(*names).collect())


def test_repeated_headings_query(spark, small):
    got = {r.document_id: r.text for r in document_queries.repeated_headings(spark, small).collect()}
    for k, n in notes(spark, small).items():
        lines, last = [], None
        for line in (n.text + "\n\n" + n.text).split("\n"):
            if line.startswith("#") and last == line.lower():
                continue
            last = line.lower() if line.startswith("#") else None if line.strip() else last
            lines.append(line)
        squeeze = lambda t: re.sub(r"\n+", "\n", t)
        assert squeeze(got[k]) == squeeze("\n".join(lines))


def test_html_query(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in document_queries.html_fast_path(spark, small).collect()}
    assert set(got) == set(pages)
    for k, page in pages.items():
        body = re.sub(r"(?s)<(script|style|nav|head)[ >].*?</\1>|<!--.*?-->", " ", page)
        plain = unescape(re.sub(r"<[^>]*>", " ", body))
        assert "".join(re.findall(r"\w+", got[k])) == "".join(re.findall(r"\w+", plain))


def test_ingest_query(spark, small):
    docs = {str(r.doc_id): r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows: dict = {}
    for r in document_queries.ingest_documents(spark, small).collect():
        rows.setdefault(r.document_id, []).append(r)
    clean = lambda t: re.sub(r"\n{3,}", "\n\n", t).strip()
    assert set(rows) == {k for k, d in docs.items() if clean(d.text or "")}
    for k, chunks in rows.items():
        name = docs[k].source + ".md"
        want = [(p.header_path, c) for p in markdown.parents(name, markdown.blocks(clean(docs[k].text))) for c in markdown.children(p.content)]
        chunks.sort(key=lambda r: r.chunk_index)
        assert [(r.header_path, r.content) for r in chunks] == want
        for r in chunks[:3]:
            raw = [b / 255 * 2 - 1 for b in hashlib.sha256(f"title: {r.header_path} | text: {r.content}".encode()).digest()[:8]]
            assert abs(r.first - raw[0] / sum(x * x for x in raw) ** 0.5) < 1e-5


def test_transcripts(spark):
    s = spark.createDataFrame([("a.mp3", 0.0, 30.0, " one "), ("a.mp3", 30.5, 75.0, "two"), ("a.mp3", 130.0, 150.0, "three")], "file_name string, start double, end double, text string")
    files = spark.createDataFrame([("a.mp3", 1.7e9), ("b.mp3", None)], "file_name string, ingested_at double")
    got = {r.file_name: r.text for r in ingest.transcripts(files, s).collect()}
    assert got["a.mp3"] == "# Transcrição de Áudio: a.mp3\n*Data de Ingestão: 2023-11-14 22:13:20 UTC*\n\n## [00:00 - 01:15]\none two\n\n## [02:10 - 02:30]\nthree"
    assert got["b.mp3"] == "# Transcrição de Áudio: b.mp3\n*Data de Ingestão: N/A*\n\n" + ingest.NO_AUDIO
    replies = spark.createDataFrame([("a", '{"text": "t", "segments": [{"start": 1, "end": 2, "text": "x"}]}'), ("b", '{"text": "whole"}'), ("c", "broken")], "file_name string, reply string")
    assert sorted(tuple(r) for r in ingest.segments_of(replies).collect()) == [("a", 1.0, 2.0, "x"), ("b", 0.0, 0.0, "whole")]


def test_html():
    page = "<html><head><title>x</title><script>var t='</p>'</script></head><body><nav><a>menu</a></nav><h2>Head &amp; line</h2><p>one <b>two</b><br>three</p><ul><li>item</li></ul></body></html>"
    assert html.to_markdown(page) == "## Head & line\n\none two\n\nthree\n\n- item"


def test_files(spark, tmp_path):
    (tmp_path / "kb" / "raw").mkdir(parents=True)
    (tmp_path / "kb" / "raw" / "a.md").write_text("# é", encoding="utf-8")
    (tmp_path / "kb" / "raw" / "b.txt").write_bytes("é".encode("latin-1"))
    got = {r.file_name: r.text for r in files.texts(spark, str(tmp_path), "kb").collect()}
    assert got == {"a.md": "# é", "b.txt": "é"}
    assert files.objects(spark, str(tmp_path), "kb").count() == 2 and files.objects(spark, str(tmp_path), "none").count() == 0
    with pytest.raises(ValueError, match="leaves"):
        files.safe_path("/x", "../y")
    done = spark.createDataFrame([("k", "d", 1)], "kb_id string, document_id string, page int")
    files.save_checkpoint(done, str(tmp_path), "pages")
    work = spark.createDataFrame([("k", "d", 1), ("k", "d", 2)], "kb_id string, document_id string, page int")
    assert files.not_done(work, spark.read.parquet(f"{tmp_path}/checkpoints/pages"), ["kb_id", "document_id", "page"]).count() == 1
    pages = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one")], "document_id string, page int, markdown string")
    assert files.assemble_pages(pages).first().text == "one\n\ntwo"
    (tmp_path / "log.json").write_text('{"event_id":"e1","aggregate_id":"a","event_type":"X","event_version":1,"occurred_at":"2026-01-01T00:00:00Z","payload":{"k":[1]}}\nbroken\n')
    log = files.events_from_json(spark, str(tmp_path / "log.json")).collect()
    assert len(log) == 1 and log[0].payload == '{"k":[1]}' and log[0].event_version == 1
