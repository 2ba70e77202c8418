"""Queries of documents: text functions, Markdown, search, extraction, quality, and streams over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import sql, vectors
from strataloom.functions import text as T
from strataloom.operators import ingest, markdown, ontology, search, search_index, stages, toc
from strataloom.operators import quality as Q
from strataloom.plans import data as D
from strataloom.plans.registry import query
from strataloom.sources import files, html
from strataloom.storage import shared_folder
from strataloom.streaming import native


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END::BIGINT AS chunk_tokens, CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 3.3::DOUBLE)) END::BIGINT AS budget_tokens, (len(regexp_extract_all(text, '[^ \\t-\\r]+')) + 500)::BIGINT AS word_tokens, CASE WHEN strlen(text) = 0 THEN 100 ELSE greatest(1, strlen(text) // 4) END::BIGINT AS payload_tokens FROM documents")
def token_estimates(spark, d):
    t = F.col("text")
    return D.table(spark, d, "documents").select("doc_id", T.chunk_tokens(t).cast("long").alias("chunk_tokens"), T.budget_tokens(t).cast("long").alias("budget_tokens"), T.words_and_margin(t).cast("long").alias("word_tokens"), T.payload_tokens(F.encode(t, "utf-8")).cast("long").alias("payload_tokens"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9_]', '_', 'g') AS label, upper(regexp_replace(p_type, '[^a-zA-Z0-9_]', '_', 'g')) AS rel_type, 'Field_' || regexp_replace(p_size || ' ' || p_brand, '[^a-zA-Z0-9_]', '_', 'g') AS field, 'kb_' || replace(p_name || '-' || p_partkey, '-', '_') AS graph FROM part")
def identifier_sanitize(spark, d):
    p = D.table(spark, d, "part")
    return p.select("p_partkey", T.identifier(F.col("p_name")).alias("label"), T.identifier(F.col("p_type"), upper=True).alias("rel_type"), T.field_name(F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_brand")).alias("field"), T.graph_name(F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string"))).alias("graph"))


@query("""SELECT page_id, CASE WHEN ending IN ('.html', '.com') AND page_id % 3 = 0 THEN 'document' WHEN page_id % 3 = 1 THEN 'image' WHEN page_id % 3 = 2 THEN 'audio' ELSE 'document' END AS source_type, base
FROM (SELECT page_id, regexp_extract(lower(url), '(\\.[^.]+)$', 1) AS ending, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages)""".replace("\\\\", "\\"))
def source_type_infer(spark, d):
    p = D.table(spark, d, "pages")
    mime = F.when(F.col("page_id") % 3 == 1, "image/png").when(F.col("page_id") % 6 == 2, "audio/mpeg").when(F.col("page_id") % 6 == 5, "video/3gpp")
    return p.select("page_id", T.source_type(mime, F.col("url")).alias("source_type"), T.base_name(F.col("url")).alias("base"))


@query("SELECT p_partkey, CASE WHEN s = '' THEN 'section' ELSE s END AS anchor FROM (SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9_\\s-]', '', 'g')), '[-\\s]+', '-', 'g') AS s FROM part)".replace("\\\\", "\\"))
def slugify(spark, d):
    return D.table(spark, d, "part").select("p_partkey", T.anchor(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("anchor"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as Markdown: a title, a heading for each turn, lists and quotes by role."""
    c = D.table(spark, d, "conversations")
    head = F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(". "), F.col("role"), F.lit("\n\n"))
    body = F.when(F.col("role") == "user", F.concat(F.lit("> "), "text")).when(F.col("role") == "system", F.concat(F.lit("| note | text |\n| --- | --- |\n| 1 | "), F.regexp_replace("text", "\n", " "), F.lit(" |"))).otherwise(F.col("text"))
    pages = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.concat(head, body).alias("markdown"))
    return files.assemble_pages(pages).select("document_id", F.concat(F.lit("note-"), F.col("document_id").cast("string"), F.lit(".md")).alias("document_name"), F.concat(F.lit("# Conversation "), F.col("document_id").cast("string"), F.lit("\n\n"), "text").alias("text"), F.lit("document").alias("source_type"), F.lit(1.7e9).alias("ingested_at"))


_SQL_NOTES = """pages AS (SELECT conv_id AS document_id, turn AS page, '## ' || turn || '. ' || role || chr(10) || chr(10) || CASE role WHEN 'user' THEN '> ' || text WHEN 'system' THEN '| note | text |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || replace(text, chr(10), ' ') || ' |' ELSE text END AS markdown FROM conversations),
notes AS (SELECT document_id, 'note-' || document_id || '.md' AS document_name, '# Conversation ' || document_id || chr(10) || chr(10) || string_agg(markdown, chr(10) || chr(10) ORDER BY page) AS text FROM pages GROUP BY 1)"""


@query(f"WITH {_SQL_NOTES} SELECT document_id, md5(text) AS digest, length(text) AS n_chars FROM notes")
def page_assembly(spark, d):
    return _notes(spark, d).select("document_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {_SQL_NOTES}, l AS (SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM notes) SELECT document_id, pos, length(regexp_extract(trim(line), '^(#{{1,6}})\\s+.+$', 1)) AS level, regexp_extract(trim(line), '^#{{1,6}}\\s+(.+)$', 1) AS title FROM l WHERE regexp_matches(trim(line), '^#{{1,6}}\\s+.+$')".replace("\\\\", "\\"))
def document_headings(spark, d):
    return _notes(spark, d).select("document_id", F.inline(T.headings(F.col("text")))).select("document_id", F.col("pos").cast("long").alias("pos"), F.col("level").cast("long").alias("level"), "title")


@query(r"""WITH raw AS (SELECT doc_id, '<!-- PAGE 1 -->' || chr(10) || '# ' || lang || chr(10) || chr(10) || '<!--PAGE 22-->' || chr(10) || '### ' || upper(lang) || ' ' || chr(10) || '<!-- note -->' || chr(10) || '## ' || lang || chr(10) || text || chr(10) || chr(10) || chr(10) || '<!--  [Erro no OCR da Página 3:' || chr(10) || 'timeout]  -->' || chr(10) || chr(10) || '# End' || chr(10) || '  ' || chr(10) || '<!-- PAGE' || chr(9) || '4-->' || chr(10) || '#### end' || chr(10) AS text FROM documents),
bare AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '<!--\s*PAGE\s*\d+\s*-->', '', 'g'), '(?s)<!--\s*\[Erro no OCR.*?\]\s*-->', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM raw),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM bare)),
kinds AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\s+.+$') THEN 'h' || lower(trim(regexp_extract(line, '^#{1,6}\s+(.+)$', 1))) WHEN trim(line, ' ' || chr(9)) <> '' THEN 'text' END AS kind FROM lines),
seen AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM kinds),
twice AS (SELECT *, coalesce(kind LIKE 'h%' AND kind = before, false) AS again FROM seen),
gone AS (SELECT *, again OR (kind IS NULL AND coalesce(first_value(CASE WHEN kind IS NOT NULL THEN again END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false)) AS dropped FROM twice)
SELECT doc_id, md5(trim(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), chr(10) || ' ' || chr(9))) AS digest FROM gone GROUP BY doc_id""")
def markdown_normalize(spark, d):
    """Documents as recognition would give them: marks in several spellings, headings repeated over page ends."""
    head = F.concat(F.lit("<!-- PAGE 1 -->\n# "), "lang", F.lit("\n\n<!--PAGE 22-->\n### "), F.upper("lang"), F.lit(" \n<!-- note -->\n## "), "lang", F.lit("\n"))
    tail = F.lit("\n\n\n<!--  [Erro no OCR da Página 3:\ntimeout]  -->\n\n# End\n  \n<!-- PAGE\t4-->\n#### end\n")
    return D.table(spark, d, "documents").select("doc_id", F.md5(markdown.normalized(F.concat(head, "text", tail))).alias("digest"))


#: Notes with every kind of block: a fence that holds what looks like others, breaks, lists.
_MORE = "\n\n```py\n# no heading\n\n- no list\n```\n```\nagain\n```\n- a\n+ b\n1. c\nafter a list\n---\n * * *\n| t |\n|x\n###### Deep \n#none\n"
_SQL_BLOCKS = f"""more AS (SELECT document_id, document_name, text || CASE WHEN document_id % 3 = 0 THEN '{_MORE}' ELSE '' END AS text FROM notes),
lines AS (SELECT document_id, document_name, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT document_id, document_name, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM more)),
bare AS (SELECT *, trim(line, ' ' || chr(9)) AS b, trim(line, ' ' || chr(9)) LIKE '```%' AS fence, count(*) FILTER (trim(line, ' ' || chr(9)) LIKE '```%') OVER (PARTITION BY document_id ORDER BY pos) AS fences FROM lines),
kinds AS (SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN 'code_block' WHEN b = '' THEN NULL WHEN regexp_matches(b, '^#{{1,6}}\\s+.+$') THEN 'heading' WHEN regexp_matches(b, '^([-*_]\\s*){{3,}}$') THEN 'thematic_break' WHEN left(b, 1) = '|' AND right(b, 1) = '|' THEN 'table' WHEN left(b, 1) = '>' THEN 'blockquote' WHEN regexp_matches(b, '^([*+-]|\\d+\\.)\\s+.+$') THEN 'list' ELSE 'paragraph' END AS kind FROM bare),
begun AS (SELECT *, (kind IN ('heading', 'thematic_break') OR fence AND fences % 2 = 1 OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY document_id ORDER BY pos))::INT AS fresh FROM kinds),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY pos) AS run FROM begun WHERE kind IS NOT NULL),
grouped AS (SELECT document_id, document_name, run, any_value(kind) AS kind, string_agg(line, chr(10) ORDER BY pos) AS raw FROM runs GROUP BY ALL),
trimmed AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10)) AS content FROM grouped),
blocks AS (SELECT document_id, document_name, row_number() OVER (PARTITION BY document_id ORDER BY run) - 1 AS block, kind, content, greatest(1, length(CASE WHEN kind IN ('heading', 'thematic_break') THEN raw ELSE content END) // 4) AS tokens,
  CASE WHEN kind = 'heading' THEN length(regexp_extract(content, '^#+')) END AS level, CASE WHEN kind = 'heading' THEN trim(regexp_replace(content, '^#+', '')) END AS title FROM trimmed WHERE content <> '')""".replace("\\\\", "\\")


def _more_notes(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).withColumn("text", F.concat("text", F.when(F.col("document_id") % 3 == 0, _MORE).otherwise("")))


@query(f"WITH {_SQL_NOTES}, {_SQL_BLOCKS} SELECT document_id::VARCHAR AS document_id, block::INT AS pos, kind AS block_type, content, tokens::INT AS estimated_tokens, level::INT AS header_level, title AS header_title FROM blocks")
def lexer_blocks(spark, d):
    return markdown.block_table(_more_notes(spark, d))


@query(f"""WITH RECURSIVE {_SQL_NOTES}, {_SQL_BLOCKS},
walk AS (SELECT DISTINCT document_id, -1::BIGINT AS block, 1::BIGINT AS parent, 0::BIGINT AS held FROM blocks
  UNION ALL SELECT b.document_id, b.block, CASE WHEN w.held > 0 AND w.held + b.tokens > 700 THEN w.parent + 1 ELSE w.parent END, CASE WHEN w.held + b.tokens > 700 THEN b.tokens ELSE w.held + b.tokens END FROM walk w JOIN blocks b ON b.document_id = w.document_id AND b.block = w.block + 1),
placed AS (SELECT b.*, w.parent, max(w.parent) OVER (PARTITION BY b.document_id) AS parents FROM walk w JOIN blocks b ON b.document_id = w.document_id AND b.block = w.block),
packed AS (SELECT document_id, document_name, parent, trim(string_agg(content, chr(10) || chr(10) ORDER BY block), ' ' || chr(9) || chr(10)) AS content, max(block) AS last FROM placed GROUP BY ALL),
closed AS (SELECT p.*, coalesce((SELECT min(b.block) FROM blocks b WHERE b.document_id = p.document_id AND b.block > p.last), p.last) AS at FROM packed p),
open_at AS (SELECT c.document_id, c.parent, h.level, h.content FROM closed c JOIN blocks h ON h.document_id = c.document_id AND h.kind = 'heading' AND h.block <= c.at
  WHERE NOT EXISTS (SELECT 1 FROM blocks o WHERE o.document_id = c.document_id AND o.kind = 'heading' AND o.block > h.block AND o.block <= c.at AND o.level <= h.level)),
paths AS (SELECT document_id, parent, string_agg(content, ' > ' ORDER BY level) AS path FROM open_at GROUP BY ALL)
SELECT c.document_id::VARCHAR AS document_id, c.parent::INT AS parent_index, '[Doc: ' || document_name || '] > ' || coalesce(path, 'Part ' || c.parent) AS header_path, content, greatest(1, length(content) // 4)::INT AS token_count
FROM closed c LEFT JOIN paths USING (document_id, parent)""")
def parent_packing(spark, d):
    """Parents under a limit that no block of the notes is beyond; in ``parent_chunks`` some are."""
    p = markdown.parent_table(_more_notes(spark, d), markdown.Limits(parent_tokens=700))
    return p.select("document_id", "parent_index", "header_path", "content", "token_count")


@query()
def parent_chunks(spark, d):
    return markdown.parent_table(_notes(spark, d), markdown.Limits(parent_tokens=400))


@query()
def child_chunks(spark, d):
    return markdown.child_table(_notes(spark, d))


@query()
def repeated_headings(spark, d):
    return _notes(spark, d).select("document_id", markdown.without_repeated_headings(F.concat("text", F.lit("\n\n"), "text")).alias("text"))


@query("""WITH RECURSIVE s AS (SELECT 'call-' || conv_id AS file_name, turn * 40.0::DOUBLE AS start, turn * 40.0::DOUBLE + length(text) % 45 AS "end", trim(text, ' ' || chr(9) || chr(10)) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''),
w AS (SELECT file_name, n, 0 AS block, start, "end" AS stop, start AS first FROM s WHERE n = 1
 UNION ALL SELECT s.file_name, s.n, CASE WHEN s."end" - w.first > 120 OR s.start - w.stop > 10 THEN w.block + 1 ELSE w.block END, s.start, s."end", CASE WHEN s."end" - w.first > 120 OR s.start - w.stop > 10 THEN s.start ELSE w.first END FROM w JOIN s ON s.file_name = w.file_name AND s.n = w.n + 1),
b AS (SELECT w.file_name, block, min(first) AS start, arg_max(stop, w.n) AS "end", string_agg(text, ' ' ORDER BY w.n) AS text FROM w JOIN s ON s.file_name = w.file_name AND s.n = w.n GROUP BY 1, 2)
SELECT *, '[' || lpad(floor(start / 60)::INT::VARCHAR, 2, '0') || ':' || lpad((start::INT % 60)::VARCHAR, 2, '0') || ' - ' || lpad(floor("end" / 60)::INT::VARCHAR, 2, '0') || ':' || lpad(("end"::INT % 60)::VARCHAR, 2, '0') || ']' AS span FROM b""")
def audio_blocks(spark, d):
    c = D.table(spark, d, "conversations")
    start = F.col("turn") * 40.0
    s = c.select(F.concat(F.lit("call-"), F.col("conv_id").cast("string")).alias("file_name"), start.alias("start"), (start + F.length("text") % 45).alias("end"), "text")
    return markdown.audio_block_table(s).withColumn("span", F.concat(F.lit("["), T.clock(F.col("start")), F.lit(" - "), T.clock(F.col("end")), F.lit("]")))


_ASCII = "'[^a-z0-9_\\s-]'".replace("\\\\", "\\")


def _searched(spark, d):
    notes = _notes(spark, d)
    docs = notes.select(F.col("document_id").alias("doc_id"), F.col("document_id").alias("doc_pos"), F.col("document_name").alias("file_name"), F.col("text").alias("markdown"))
    chunks = D.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.concat(F.lit("Notes > ## "), F.col("turn").cast("string"), F.lit(". "), "role").alias("header_path"))
    return docs, chunks


@query(f"""WITH {_SQL_NOTES}, q AS (SELECT 'system' AS w),
l AS (SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM notes),
hits AS (SELECT document_id, document_name, 2 AS stage, page AS pos, page || '. ' || role AS title, 'Seção em Notes > ## ' || page || '. ' || role AS preview FROM notes JOIN (SELECT conv_id, turn AS page, role FROM conversations) ON conv_id = document_id, q WHERE role LIKE '%' || w || '%'
  UNION ALL SELECT document_id, document_name, 3, pos, regexp_replace(trim(line), '^#+\\s*', ''), 'Seção: ' || regexp_replace(trim(line), '^#+\\s*', '') FROM l JOIN notes USING (document_id), q WHERE trim(line) LIKE '#%' AND lower(line) LIKE '%' || w || '%'),
keyed AS (SELECT *, regexp_replace(trim(regexp_replace(lower(title), {_ASCII}, '', 'g')), '[-\\s]+', '-', 'g') AS anchor FROM hits),
first AS (SELECT *, row_number() OVER (PARTITION BY document_id, anchor ORDER BY stage, pos) AS n FROM keyed)
SELECT document_id AS doc_id, document_name AS file_name, 'header' AS match_type, title, anchor, preview FROM first WHERE n = 1 ORDER BY document_id, stage, pos LIMIT 20""".replace("\\\\", "\\"))
def quick_search(spark, d):
    return search.quick_search(*_searched(spark, d), "Sýstem", 20)


@query(f"""WITH {_SQL_NOTES}, q AS (SELECT 'system' AS w),
l AS (SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM notes),
hits AS (SELECT document_id, document_name, 2 AS stage, page AS pos, page || '. ' || role AS title, 'Seção em Notes > ## ' || page || '. ' || role AS preview FROM notes JOIN (SELECT conv_id, turn AS page, role FROM conversations) ON conv_id = document_id, q WHERE role LIKE '%' || w || '%'
  UNION ALL SELECT document_id, document_name, 3, pos, regexp_replace(trim(line), '^#+\\s*', ''), 'Seção: ' || regexp_replace(trim(line), '^#+\\s*', '') FROM l JOIN notes USING (document_id), q WHERE trim(line) LIKE '#%' AND lower(line) LIKE '%' || w || '%'),
keyed AS (SELECT *, regexp_replace(trim(regexp_replace(lower(title), {_ASCII}, '', 'g')), '[-\\s]+', '-', 'g') AS anchor FROM hits),
first AS (SELECT *, row_number() OVER (PARTITION BY document_id, anchor ORDER BY stage, pos) AS n FROM keyed)
SELECT document_id AS doc_id, document_name AS file_name, 'header' AS match_type, title, anchor, preview FROM first WHERE n = 1 ORDER BY document_id, stage, pos LIMIT 20""".replace("\\\\", "\\"))
def quick_search_indexed(spark, d):
    """The same through the index of trigrams."""
    index = search_index.build(*_searched(spark, d), shared_folder(spark, "search"))
    return search_index.quick_search(spark, index, "Sýstem", 20)


@query(f"""WITH {_SQL_NOTES}, q AS (SELECT DISTINCT role AS query_id, substr(role, 2, 4) AS w FROM conversations UNION ALL SELECT 'all-' || left(role, 1), left(role, 1) FROM (SELECT DISTINCT role FROM conversations) UNION ALL SELECT 'note', 'note-' || 1 UNION ALL SELECT 'none', 'no such heading'),
l AS (SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM notes),
hits AS (SELECT query_id, document_id, document_name, 1 AS stage, 0 AS pos, document_name AS title, '' AS anchor, 'Nota cadastrada na base' AS preview FROM notes, q WHERE contains(lower(document_name), w)
  UNION ALL SELECT query_id, document_id, document_name, 2, page, page || '. ' || role, NULL, 'Seção em Notes > ## ' || page || '. ' || role FROM notes JOIN (SELECT conv_id, turn AS page, role FROM conversations) ON conv_id = document_id, q WHERE contains('notes > ## ' || page || '. ' || role, w)
  UNION ALL SELECT query_id, document_id, document_name, 3, pos, regexp_replace(trim(line), '^#+\\s*', ''), NULL, 'Seção: ' || regexp_replace(trim(line), '^#+\\s*', '') FROM l JOIN notes USING (document_id), q WHERE trim(line) LIKE '#%' AND contains(lower(trim(line)), w)),
keyed AS (SELECT * REPLACE (coalesce(anchor, regexp_replace(trim(regexp_replace(lower(title), {_ASCII}, '', 'g')), '[-\\s]+', '-', 'g')) AS anchor) FROM hits),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, CASE stage WHEN 1 THEN 'title' ELSE anchor END ORDER BY stage, pos) AS n FROM keyed)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY document_id, stage, pos) AS rank, document_id AS doc_id, document_name AS file_name, CASE stage WHEN 1 THEN 'title' ELSE 'header' END AS match_type, title, anchor, preview FROM firsts WHERE n = 1 QUALIFY rank <= 10""".replace("\\\\", "\\"))
def search_many(spark, d):
    """Many searches at once through the index, some too short for it, accents in some."""
    roles = D.table(spark, d, "conversations").select("role").distinct()
    asked = roles.select(F.col("role").alias("query_id"), F.translate(F.substring("role", 2, 4), "ys", "ýS").alias("query"))
    asked = asked.unionByName(roles.select(F.concat(F.lit("all-"), F.substring("role", 1, 1)).alias("query_id"), F.upper(F.substring("role", 1, 1)).alias("query")))
    asked = asked.unionByName(spark.createDataFrame([("note", " Nóte-1"), ("none", "no such heading")], "query_id string, query string"))
    index = search_index.build(*_searched(spark, d), shared_folder(spark, "search"))
    return search_index.search_many(spark, index, asked).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH h AS (SELECT item_id, sha256('title: none | text: ' || text) AS h FROM benchmark), r AS (SELECT item_id, unnest(range(16)) AS pos, ('0x' || substr(h, unnest(range(16)) * 2 + 1, 2))::INT / 255.0::DOUBLE * 2 - 1 AS raw FROM h)
SELECT item_id, pos, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY item_id)), 6) AS value FROM r""")
def hash_embedding(spark, d):
    return D.table(spark, d, "benchmark").select("item_id", F.posexplode(vectors.hash_embedding(vectors.passage_prompt(F.lit(None).cast("string"), F.col("text")), 16)).alias("pos", "value")).select("item_id", "pos", F.round("value", 6).alias("value"))


_P = ontology.Property
ONTOLOGY = ontology.Ontology(
    "languages",
    1,
    (
        ontology.NodeType("The", (_P("code", required=True, values=("en", "de")),)),
        ontology.NodeType("Der", (_P("count", "integer", True), _P("note", default="d"), _P("free"))),
        ontology.NodeType("La", (_P("tags", "list[string]", True), _P("name", required=True))), ontology.NodeType("Que"),
    ),
    (ontology.Relation("NEXT_TO", "The", "Der"), ontology.Relation("LIKE", "La", "Que", (_P("weight", "float", default=0.5),)), ontology.Relation("LOST", "The", "Nobody")),
)


@query("""WITH t AS (SELECT * FROM (VALUES ('The', 'code=en'), ('Der', 'count=1,note=d'), ('La', 'name=Sample,tags=["sample"]'), ('Que', '')) t(name, properties)), r AS (SELECT * FROM (VALUES ('NEXT_TO', 'The', 'Der', ''), ('LIKE', 'La', 'Que', 'weight=0.5')) r(rel_type, s, o, properties))
SELECT doc_id AS parent_id, lower(name) || '-1' AS a, '' AS b, name AS kind, properties FROM documents, t WHERE contains(lower(text), lower(name)) UNION ALL
SELECT doc_id, lower(s) || '-1', lower(o) || '-1', rel_type, properties FROM documents, r WHERE contains(lower(text), lower(s)) AND contains(lower(text), lower(o))""")
def heuristic_extract(spark, d):
    n, e = ontology.extract(D.table(spark, d, "documents").select(F.col("doc_id").alias("parent_id"), "text"), ONTOLOGY)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",").alias("properties")
    return n.select("parent_id", F.col("entity_id").alias("a"), F.lit("").alias("b"), F.col("label").alias("kind"), shown).unionByName(e.select("parent_id", F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("rel_type").alias("kind"), shown))


@query("""WITH r AS (SELECT o_orderkey AS parent_id, o_custkey % 7 AS a, o_custkey % 5 AS b, o_orderkey % 4 AS k FROM orders),
nodes AS (SELECT parent_id, 'law' || a AS entity_id, 'Law' AS label, 'kind=' || CASE WHEN k < 2 THEN 'old' ELSE 'new' END || ',name=Law ' || a || CASE WHEN k = 1 THEN ',tags=["x","y"]' ELSE '' END AS properties FROM r WHERE k < 3
  UNION ALL SELECT parent_id, 'court' || b, 'Court', 'name=court' || b FROM r WHERE k < 3)
SELECT parent_id, entity_id AS a, '' AS b, label AS kind, replace(properties, 'kind=new,', '') AS properties FROM nodes
UNION ALL SELECT parent_id, 'court' || b, 'law' || a, 'RULES', 'year=' || (1900 + k) FROM r WHERE k < 3""")
def model_extract(spark, d):
    """Graphs out of a model's replies: ids cleaned, values outside an enumeration dropped, loose ends dropped."""
    onto = ontology.Ontology("law", 1, (ontology.NodeType("Law", (_P("kind", values=("old",)), _P("name"), _P("tags", "list[string]"))), ontology.NodeType("Court")), (ontology.Relation("RULES", "Court", "Law", (_P("year", "integer"),)),))
    o = D.table(spark, d, "orders")
    a, b, k = (F.col("o_custkey") % 7).cast("string"), (F.col("o_custkey") % 5).cast("string"), F.col("o_orderkey") % 4
    reply = F.concat(
        F.lit('Here: {"Law": [{"id": " LAW'), a, F.lit(' ", "kind": "'), F.when(k < 2, "old").otherwise("new"), F.lit('", "name": "Law '), a, F.lit('"'), F.when(k == 1, ', "tags": ["x", "y"]').otherwise(""), F.lit('}, {"id": "  "}], "Court": [{"id": "court'), b,
        F.lit('"}], "RULES": [{"source_id": "Court'), b, F.lit('", "target_id": "law'), a, F.lit('", "year": '), (1900 + k).cast("string"), F.lit('}, {"source_id": "nobody", "target_id": "law'), a, F.lit('"}]}'),
    )
    replies = o.select(F.col("o_orderkey").alias("parent_id"), F.when(k < 3, reply).otherwise("no graph").alias("reply"))
    n, e = ontology.graph_rows(ontology.parse_graphs(replies, onto).filter("graph is not null"), onto)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",").alias("properties")
    return n.select("parent_id", F.col("entity_id").alias("a"), F.lit("").alias("b"), F.col("label").alias("kind"), shown).unionByName(e.select("parent_id", F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("rel_type").alias("kind"), shown))


@query(r"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '[{"n": 1}, {"n": [2]}]' WHEN 1 THEN '[{"n": 3}]' WHEN 2 THEN '[{"n": ' || o_custkey || '}]' END AS part FROM orders""")
def json_salvage(spark, d):
    """The array in replies that are fenced, fenced with words and marks of references after, bare among words, or none."""
    k = F.col("o_orderkey") % 4
    reply = F.when(k == 0, '```json\n[{"n": 1}, {"n": [2]}]\n```\nSee [1] and [2].').when(k == 1, 'As asked:\n```\n[{"n": 3}]```').when(k == 2, F.concat(F.lit('Entries [{"n": '), F.col("o_custkey").cast("string"), F.lit("}] follow."))).otherwise("no entries")
    return D.table(spark, d, "orders").select("o_orderkey", T.json_part(reply).alias("part"))


@query("""WITH nodes AS (SELECT o_custkey AS graph_id, o_orderkey AS entity_id, o_orderstatus AS label FROM orders), edges AS (SELECT o_custkey AS graph_id, o_orderkey AS source_id, o_orderkey + (o_orderkey % 3) AS target_id FROM orders),
e AS (SELECT graph_id, avg(CASE WHEN EXISTS (SELECT 1 FROM nodes n WHERE n.graph_id = edges.graph_id AND n.entity_id = target_id) THEN 1.0 ELSE 0.0 END) * 100 AS integrity FROM edges GROUP BY 1), n AS (SELECT graph_id, avg(CASE WHEN label IN ('F', 'O') THEN 1.0 ELSE 0.0 END) * 100 AS adherence FROM nodes GROUP BY 1)
SELECT graph_id, round(coalesce(integrity, 100), 6) AS integrity, round(adherence, 6) AS adherence FROM n LEFT JOIN e USING (graph_id)""")
def extraction_quality(spark, d):
    o = D.table(spark, d, "orders")
    n = o.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("entity_id"), F.col("o_orderstatus").alias("label"))
    e = o.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("source_id"), (F.col("o_orderkey") + F.col("o_orderkey") % 3).alias("target_id"))
    return ontology.quality(n, e, ["F", "O"]).select("graph_id", F.round("integrity", 6).alias("integrity"), F.round("adherence", 6).alias("adherence"))


# Recognized pages: notes with a figure in each second one; what is expected depends on the note.
_FIGURE = "> **[Figura 1]** Descrição visual: x"


@query(f"""WITH {_SQL_NOTES}, p AS (SELECT document_id, CASE WHEN document_id % 2 = 0 THEN text || chr(10) || '{_FIGURE}' ELSE text END AS text, document_id % 4 <> 3 AS tables, document_id % 5 <> 0 AS heads, document_id % 3 = 0 AS fig FROM notes),
c AS (SELECT *, lower(text) AS low, regexp_matches(text, '\\|[-:\\s]+\\|') AND len(regexp_extract_all(text, '\\|[^\\n]*\\|')) >= 3 AS is_table FROM p),
s AS (SELECT *, ((low LIKE '%note%')::INT + (low LIKE '%text%')::INT + (low LIKE '%absent column%')::INT) / 3.0 AS cols, ((low LIKE '%1. user%')::INT + (low LIKE '%2. assistant%')::INT) / 2.0 AS hs, ((low LIKE '%the%')::INT + (low LIKE '%der%')::INT + (low LIKE '%que%')::INT + (low LIKE '%la%')::INT) / 4.0 AS ks,
  (CASE WHEN regexp_matches(text, '(?i)(>\\s*\\*\\*\\[Figura|\\[Figura\\s*\\d+)') THEN 50 ELSE 0 END) + (CASE WHEN regexp_matches(text, '(?i)descri[cç][aã]o\\s*visual') THEN 50 ELSE 0 END) AS figs FROM c),
w AS (SELECT *, CASE WHEN is_table THEN 50 + 50 * cols ELSE 40 * cols END AS ts, CASE WHEN tables THEN 0.35 ELSE 0 END AS wt, CASE WHEN heads THEN 0.25 ELSE 0 END AS wh, CASE WHEN fig THEN 0.35 ELSE 0 END AS wf FROM s)
SELECT document_id, round(CASE WHEN tables THEN ts ELSE 100 END, 6) AS score_tables, round(CASE WHEN heads THEN hs * 100 ELSE 100 END, 6) AS score_headings, round(ks * 100, 6) AS score_keywords, CASE WHEN fig THEN figs ELSE 100 END::DOUBLE AS score_figures, round((ts * wt + hs * 100 * wh + ks * 100 * 0.25 + figs * wf) / (wt + wh + 0.25 + wf), 6) AS quality FROM w""")
def ocr_quality(spark, d):
    key = F.col("document_id")
    wanted = lambda *x: F.array(*[F.lit(w) for w in x])
    none = F.array().cast("array<string>")
    p = _notes(spark, d).select("document_id", F.when(key % 2 == 0, F.concat("text", F.lit("\n" + _FIGURE))).otherwise(F.col("text")).alias("text"))
    p = p.withColumns({"columns": F.when(key % 4 != 3, wanted("Note", "text", "absent column")).otherwise(none), "headings": F.when(key % 5 != 0, wanted("1. user", "2. Assistant")), "keywords": wanted("the", "der", "que", "la"), "has_figure": key % 3 == 0})
    scores = ["score_tables", "score_headings", "score_keywords", "score_figures", "quality"]
    return Q.ocr_scores(p).select("document_id", *[F.round(c, 6).alias(c) for c in scores])


@query("SELECT source AS model, count(*) AS n, round(avg(quality * 100), 6) AS quality, round(avg(n_chars / 7.0::DOUBLE), 6) AS latency_ms, round(avg((doc_id % 5000 / 1e6::DOUBLE * 2 + n_chars / 1e6::DOUBLE * 3) * 1000), 6) AS cost_of_thousand FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def model_means(spark, d):
    x = D.table(spark, d, "documents").join(D.table(spark, d, "labels"), "doc_id")
    cost = Q.cost_of_thousand(F.col("doc_id") % 5000, F.col("n_chars"), F.lit(2.0), F.lit(3.0))
    m = Q.model_means(x.select(F.col("source").alias("model"), (F.col("quality") * 100).alias("quality"), (F.col("n_chars") / 7.0).alias("latency_ms"), cost.alias("cost_of_thousand")))
    return m.select("model", "n", *[F.round(c, 6).alias(c) for c in ("quality", "latency_ms", "cost_of_thousand")])


_SQL_TOC = "toc AS (SELECT o_custkey AS doc_id, (o_orderkey % 4 + 1)::BIGINT AS level, 't' || o_orderkey AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS page FROM orders)"
_OPEN = "(SELECT arg_max(title, page) FROM toc a WHERE a.doc_id = t.doc_id AND a.level = {k} AND a.page <= t.page AND a.page > coalesce((SELECT max(page) FROM toc b WHERE b.doc_id = t.doc_id AND b.level > 1 AND b.level < {k} AND b.page <= t.page), 0))"


def _toc(spark, d) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    page = F.row_number().over(order).cast("long")
    return D.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), page.alias("pos"), (F.col("o_orderkey") % 4 + 1).alias("level"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("title"), page.alias("page"))


@query(f"""WITH {_SQL_TOC}, o AS (SELECT t.doc_id, t.page, coalesce({_OPEN.format(k=1)}, (SELECT arg_min(title, page) FROM toc a WHERE a.doc_id = t.doc_id AND a.level = 1)) AS h1, {_OPEN.format(k=2)} AS h2, {_OPEN.format(k=3)} AS h3, {_OPEN.format(k=4)} AS h4 FROM toc t)
SELECT *, concat_ws(' -> ', '# ' || h1, '## ' || h2, '### ' || h3, '#### ' || h4) AS lineage FROM o""")
def toc_asof(spark, d):
    t = _toc(spark, d)
    return toc.hierarchy(t, t.select("doc_id", "page"))


@query(f"""WITH {_SQL_TOC}, n AS (SELECT doc_id, max(page) AS n_pages FROM toc GROUP BY 1), b AS (SELECT doc_id, n_pages, unnest(range(0, ((n_pages - 1) // 3) + 1)) AS batch FROM n),
t AS (SELECT doc_id, batch, batch * 3 + 1 AS first_page, least(batch * 3 + 3, n_pages) AS last_page, batch * 3 AS page FROM b)
SELECT doc_id, batch, first_page, last_page, {_OPEN.format(k=2)} AS section, {_OPEN.format(k=3)} AS subsection, (SELECT repeat('#', arg_max(level, page)::INT) FROM toc a WHERE a.doc_id = t.doc_id AND a.page <= t.page) AS level FROM t""")
def toc_batch_states(spark, d):
    """What is open when each batch of three pages begins."""
    t = _toc(spark, d)
    n = t.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    return toc.batch_states(t, n, 3).withColumn("batch", F.col("batch").cast("long"))


@query(f"""WITH {_SQL_TOC} SELECT doc_id, '# Índice / Table of Contents' || chr(10) || coalesce(chr(10) || string_agg(repeat('  ', (level - 2)::INT) || '- [' || title || '](#pág-' || page || ')', chr(10) ORDER BY page) FILTER (WHERE level > 1), '') AS text FROM toc GROUP BY 1""")
def toc_list(spark, d):
    return toc.contents_list(_toc(spark, d))


@query()
def html_fast_path(spark, d):
    return html.page_texts(D.table(spark, d, "pages"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_counts(spark, d):
    e = D.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return native.windowed(e, "at", "1 hour", ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def sessions(spark, d):
    e = D.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, event_type FROM events")
def stream_dedup_watermark(spark, d):
    """Each event once, though the stream delivers the log twice."""
    e = D.table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("occurred_at"))
    return native.stream_once(spark, e).select("event_id", "event_type")


@query(r"""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand ELSE p_partkey::VARCHAR END AS name, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Part' END AS label, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE '' END AS aliases FROM part""")
def entity_normalization(spark, d):
    p = D.table(spark, d, "part")
    raw = p.select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("").alias("name"), F.when(F.col("p_size") % 3 == 1, F.col("p_brand")).alias("sigla"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("entity_type"), F.lit("Part").alias("node_type"), F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).alias("alias"))
    return ingest.entity_rows(raw).select(F.col("entity_id").cast("long").alias("p_partkey"), "name", "label", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS source_id, CASE WHEN l_quantity > 25 THEN 'SUPPLIES' ELSE l_returnflag END AS rel_type FROM lineitem")
def relation_normalization(spark, d):
    li = D.table(spark, d, "lineitem")
    raw = li.select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey").alias("source_id"), F.col("l_suppkey").cast("string").alias("target_id"), F.when(F.col("l_quantity") > 25, "SUPPLIES").otherwise("").alias("relationship_type"), F.col("l_returnflag").alias("relation"))
    part = lambda k: F.split("source_id", r"\|")[k]
    return ingest.relation_rows(raw).select(part(0).cast("long").alias("l_orderkey"), part(1).cast("int").alias("l_linenumber"), part(2).alias("source_id"), "rel_type")


@query("SELECT o_orderkey, greatest(3, least(40, o_custkey)) AS page, CASE WHEN o_orderpriority LIKE '1%' THEN 'chapter' ELSE 'section' END AS type, repeat('#', (o_orderkey % 4 + 1)::INT) AS markdown_level FROM orders WHERE o_orderkey % 6 < 4 AND o_orderstatus <> 'P'")
def toc_validation(spark, d):
    o = D.table(spark, d, "orders")
    level = F.when(F.col("o_orderkey") % 6 < 4, F.repeat(F.lit("#"), (F.col("o_orderkey") % 4 + 1).cast("int"))).otherwise("#####")
    items = o.select("o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), " Chapter").otherwise(F.col("o_orderpriority")).alias("type"), level.alias("markdown_level"), F.when(F.col("o_orderstatus") == "P", "  ").otherwise(" t ").alias("title"), F.col("o_custkey").alias("page"))
    return ingest.toc_rows(items, 3, 40).select("o_orderkey", "page", "type", "markdown_level")


@query(f"WITH {_SQL_NOTES} SELECT document_id, len(regexp_extract_all(text, '\\|[-:\\s]+\\|')) AS tables, len(regexp_extract_all(text, '(?m)^#{{1,4}}\\s+.+$')) AS headings, len(regexp_extract_all(text, '(?i)(?:>\\s*\\*\\*\\[Figura|\\[Figura\\s*\\d+)')) AS figures FROM (SELECT document_id, text || CASE WHEN document_id % 2 = 0 THEN '> **[Figura 3]** and [Figura 4]' ELSE '' END AS text FROM notes)".replace("\\\\", "\\"))
def markdown_counts(spark, d):
    figures = F.when(F.col("document_id") % 2 == 0, "> **[Figura 3]** and [Figura 4]").otherwise("")
    return _notes(spark, d).select("document_id", *[c.alias(n) for n, c in T.structure_counts(F.concat("text", figures)).items()])


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'system') AS n, CASE WHEN count(*) FILTER (WHERE role = 'system') = 0 THEN 'Nenhum documento ou contexto relevante foi encontrado na Knowledge Base para responder a essa pergunta.' ELSE 'Modo retrieve: ' || count(*) FILTER (WHERE role = 'system') || ' evidências recuperadas do grafo de conhecimento.' END AS answer FROM conversations GROUP BY 1")
def answer_assembly(spark, d):
    c = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("n"))
    return c.select("conv_id", "n", ingest.answer(F.col("n"), "retrieve").alias("answer"))


@query("SELECT doc_id, left(text, 200) AS preview, strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%d %H:%M:%S UTC') AS at, concat_ws(' -> ', lang, nullif(source, 'src0')) AS lineage FROM documents")
def document_previews(spark, d):
    x = D.table(spark, d, "documents").withColumn("section", F.when(F.col("source") != "src0", F.col("source")))
    return x.select("doc_id", T.snippet(F.col("text")).alias("preview"), T.utc_time(F.col("doc_id") + 1_700_000_000).alias("at"), T.lineage("lang", "section").alias("lineage"))


@query()
def ingest_documents(spark, d):
    """Child chunks with embeddings of all documents, taken in as files."""
    files_ = D.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat("source", F.lit(".md")).alias("file_name"), F.lit("text/markdown").alias("content_type"), F.encode("text", "utf-8").alias("content"), F.lit(1.7e9).alias("ingested_at"))
    return ingest.ingest(files_, ONTOLOGY, dimensions=8)["children"].select("document_id", "child_id", "chunk_index", "header_path", "content", F.round(F.element_at("embedding", 1), 6).alias("first"))


@query(r"""WITH f AS (SELECT doc_id, doc_id % 11 = 5 AS p, doc_id % 7 = 3 AS e, doc_id % 13 = 2 AS x FROM documents WHERE regexp_matches(text, '[^ \t-\r]')), n AS (SELECT count(*) AS all_ FROM documents),
r AS (SELECT *, p OR e OR x AS late FROM f), a AS (SELECT (SELECT all_ FROM n) AS all_, count(*) AS good, count(*) FILTER (p) AS p, count(*) FILTER (NOT p AND e) AS e, count(*) FILTER (NOT p AND NOT e AND x) AS x FROM r)
SELECT run, step, done, failed FROM (SELECT unnest([
 {'run': 1, 'step': 'PARSING', 'done': good - p, 'failed': all_ - good + p}, {'run': 1, 'step': 'CHUNKING', 'done': good - p, 'failed': 0}, {'run': 1, 'step': 'EMBEDDINGS', 'done': good - p - e, 'failed': e},
 {'run': 1, 'step': 'EXTRACTION', 'done': good - p - e - x, 'failed': x}, {'run': 1, 'step': 'INDEXING', 'done': good - p - e - x, 'failed': 0},
 {'run': 2, 'step': 'PARSING', 'done': p, 'failed': all_ - good}, {'run': 2, 'step': 'CHUNKING', 'done': p, 'failed': 0}, {'run': 2, 'step': 'EMBEDDINGS', 'done': p + e, 'failed': 0},
 {'run': 2, 'step': 'EXTRACTION', 'done': p + e + x, 'failed': 0}, {'run': 2, 'step': 'INDEXING', 'done': p + e + x, 'failed': 0}], recursive := true) FROM a) WHERE done + failed > 0""")
def staged_ingestion(spark, d):
    """Two runs over all documents: in the first, some fail at parsing, embedding or extraction; the second takes only those."""
    docs = D.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.lit("text/markdown").alias("content_type"), F.encode("text", "utf-8").alias("content"), F.lit(1.7e9).alias("ingested_at"))
    key = F.col("document_id").cast("long")
    root = shared_folder(spark, "ingest")
    fails = lambda modulus, rest: F.col("document_id").cast("long") % modulus == rest  # noqa: E731  the models' columns see their document
    embed = lambda title, text: vectors.hash_embedding(vectors.passage_prompt(title, text), 4)
    first = stages.Ingestion(root, ONTOLOGY, embed=lambda title, text: F.when(~fails(7, 3), embed(title, text)), extract=lambda text: F.when(~fails(13, 2), F.lit("{}")))
    first.run(docs.withColumn("content", F.when(key % 11 != 5, F.col("content"))), 1)
    stages.Ingestion(root, ONTOLOGY, embed=embed, extract=lambda text: F.lit("{}")).run(docs, 2)
    s = first.statuses(spark).groupBy("run", "step").agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return s.select(F.col("run").cast("long").alias("run"), "step", "done", "failed")


@query()
def child_chunks_sql(spark, d):
    """``child_chunks`` as one SQL text over a table function."""
    sql.register(spark)
    text = """SELECT d.document_id, c.parent_id, c.child_id, c.chunk_index, c.header_path, c.content, d.source_type, d.ingested_at
              FROM {notes} d, LATERAL markdown_children(CAST(d.document_id AS STRING), d.document_name, d.text) c"""
    return spark.sql(text, notes=_notes(spark, d))
