"""Ingestion: routing to parsers, staged tables from raw text to an indexed graph, failures aside, finished work skipped.

External models (recognition, transcription, extraction, embedding) are column functions that a caller passes in; the
defaults here are deterministic and need no network.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions import vectors
from strataloom.operators import graph, markdown, ontology
from strataloom.operators.graph import first_text

Parser = Callable[[Column], Column]

# Answers without a language model, and the text of a transcription.
NOTHING_FOUND = "Nenhum documento ou contexto relevante foi encontrado na Knowledge Base para responder a essa pergunta."
RETRIEVED = "Modo retrieve: %d evidências recuperadas do grafo de conhecimento."
NO_SYNTHESIS = "Foram recuperadas %d evidências do grafo de conhecimento."


AUDIO_TITLE, AUDIO_DATE, NO_AUDIO = "# Transcrição de Áudio: ", "*Data de Ingestão: ", "Nenhum áudio inteligível detectado."


def transcripts(files: DataFrame, segments: DataFrame) -> DataFrame:
    """(file_name, text) of files (file_name, ingested_at) from their segments (file_name, start, end, text), in blocks."""
    blocks = markdown.audio_block_table(segments)
    part = F.concat(F.lit("## ["), T.clock(F.col("start")), F.lit(" - "), T.clock(F.col("end")), F.lit("]\n"), "text")
    # a file's blocks: one for two minutes of sound
    parts = blocks.groupBy("file_name").agg(F.sort_array(F.collect_list(F.struct("block", part.alias("part")))).alias("parts"), F.max("start").alias("seen"))
    head = F.concat(F.lit(AUDIO_TITLE), "file_name", F.lit("\n" + AUDIO_DATE), T.utc_time(F.col("ingested_at")), F.lit("*\n\n"))
    body = F.coalesce(F.array_join(F.transform("parts", lambda p: p.part), "\n\n"), F.lit(NO_AUDIO))
    return files.join(parts, "file_name", "left").select("file_name", F.concat(head, body).alias("text"))


def segments_of(replies: DataFrame) -> DataFrame:
    """(file_name, start, end, text) from a transcriber's JSON replies (file_name, reply): its segments, or where there are
    none its whole text as one."""
    kind = "struct<segments:array<struct<start:double,end:double,text:string>>,text:string>"
    r = F.from_json("reply", kind)
    found = F.coalesce(F.nullif(r.segments, F.array().cast("array<struct<start:double,end:double,text:string>>")), F.when(r.text.isNotNull(), F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), r.text.alias("text")))))
    return replies.select("file_name", F.inline(found))


def route(files: DataFrame) -> DataFrame:
    """Adds source_type from content_type and file_name."""
    return files.withColumn("source_type", T.source_type(F.col("content_type"), F.col("file_name")))


def parse(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Adds text: each source type by its parser, one that has none as a document; bytes are UTF-8, else Latin-1."""
    from strataloom.sources.files import as_text

    known = {"document": as_text} | (parsers or {})
    text = known["document"](F.col("content"))
    for kind, f in known.items():
        text = F.when(F.col("source_type") == kind, f(F.col("content"))).otherwise(text)
    return route(files).withColumn("text", markdown.normalized(text))


def entity_rows(raw: DataFrame) -> DataFrame:
    """Loose entity records as (entity_id, name, label, aliases, properties): the first filled of the fields that may hold
    each; ``properties``, a map of strings, takes in all other fields that are filled, which win over its own.

    ``raw`` has strings id, entity_type, type, node_type, name, label, rotulo, sigla, ementa, and aliases, an array, or
    alias, one name; missing columns count as empty. Rows without id are dropped.
    """
    flat = [c for c in raw.columns if c not in ("id", "entity_type", "type", "node_type", "name", "label", "aliases", "alias", "properties")]
    for c in ("id", "entity_type", "type", "node_type", "name", "label", "rotulo", "sigla", "ementa", "alias"):
        raw = raw if c in raw.columns else raw.withColumn(c, F.lit(None).cast("string"))
    aliases = F.col("aliases") if "aliases" in raw.columns else F.lit(None).cast("array<string>")
    aliases = F.coalesce(aliases, F.when(F.coalesce("alias", F.lit("")) != "", F.array("alias")), F.array().cast("array<string>"))
    extra = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in flat])) if flat else None
    own = F.coalesce("properties", F.create_map().cast("map<string,string>")) if "properties" in raw.columns else F.create_map().cast("map<string,string>")
    kept = F.map_filter(own, lambda k, v: ~k.isin(*flat)) if flat else own
    properties = F.map_concat(kept, F.map_from_entries(extra)) if flat else own
    out = raw.filter("trim(coalesce(id, '')) <> ''")
    return out.select(F.col("id").alias("entity_id"), first_text("name", "label", "rotulo", "sigla", "ementa", "id").alias("name"), F.coalesce(first_text("entity_type", "type", "node_type"), F.lit("")).alias("label"), aliases.alias("aliases"), properties.alias("properties"))


def relation_rows(raw: DataFrame) -> DataFrame:
    """Loose relation records as (source_id, target_id, rel_type)."""
    for c in ("source_id", "target_id", "relationship_type", "type", "relation", "name"):
        raw = raw if c in raw.columns else raw.withColumn(c, F.lit(None).cast("string"))
    return raw.select(F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("target_id", F.lit("")).alias("target_id"), F.coalesce(first_text("relationship_type", "type", "relation", "name"), F.lit("")).alias("rel_type"))


# Kinds of entries in a table of contents; any other becomes a section.
TOC_KINDS = ("chapter", "section", "subsection", "table", "figure", "appendix")


def toc_rows(items: DataFrame, first_page: int, last_page: int) -> DataFrame:
    """Entries (type, markdown_level, title, page): pages brought into the batch's range, unknown types to section;
    entries without a title or with a level other than # to #### are dropped."""
    page = F.greatest(F.lit(first_page), F.least(F.lit(last_page), F.coalesce(F.col("page"), F.lit(first_page))))
    kind = F.lower(F.trim(F.coalesce("type", F.lit(""))))
    ok = (F.trim(F.coalesce("title", F.lit(""))) != "") & F.col("markdown_level").rlike("^#{1,4}$")
    return items.filter(ok).withColumns({"page": page, "type": F.when(kind.isin(*TOC_KINDS), kind).otherwise("section"), "title": F.trim("title")})


def content_or_log(stored: DataFrame, log: DataFrame) -> DataFrame:
    """(document_id, text) of stored texts; a document without one has the preview of its last parsing in the log."""
    seen = log.filter(F.col("event_type") == "DocumentParsedToMarkdown").groupBy(F.col("aggregate_id").alias("document_id")).agg(F.max_by("markdown_preview", "event_version").alias("preview"))
    return stored.select("document_id", "text").join(seen, "document_id", "full").select("document_id", F.coalesce("text", "preview").alias("text")).filter("text is not null")


def content_with_headings(documents: DataFrame) -> DataFrame:
    """(document_id, text, toc): a document's Markdown and its headings in one row."""
    return documents.select("document_id", "text", T.headings(F.col("text")).alias("toc"))


def answer(count: Column, mode: str, synthesis: Column | None = None) -> Column:
    """The answer's text: fixed for no evidence and for retrieval; a synthesis where a model's column is given."""
    found = F.format_string(RETRIEVED, count) if mode == "retrieve" else synthesis if synthesis is not None else F.format_string(NO_SYNTHESIS, count)
    return F.when(count == 0, NOTHING_FOUND).otherwise(found)


def merged_graph(parents: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, mentions) of what was extracted from parents: nodes and edges merged property by property, the
    last parent's value holding, and mentions whose both ends are there."""
    entities = graph.merge_nodes(None, nodes.select("label", "entity_id", "properties", F.col("parent_id").alias("seq")))
    relations = graph.merge_edges(None, edges.select("source_id", "target_id", "rel_type", "properties", F.col("parent_id").alias("seq")), entities)
    return entities, relations, graph.known_mentions(nodes.select("parent_id", "entity_id").distinct(), parents, entities)


def ingest(files: DataFrame, onto: ontology.Ontology, done: DataFrame | None = None, parsers: dict[str, Parser] | None = None, embed: Callable[[Column, Column], Column] | None = None, dimensions: int = 768, limits: markdown.Limits = markdown.Limits()) -> dict[str, DataFrame]:
    """All tables that a batch of files yields: documents, parents, children, entities, relations, mentions, failures.

    files: document_id, file_name, content_type, content, ingested_at. ``done`` names documents (document_id) that are
    finished and are skipped. A file without any text goes to failures with the step that it failed at.
    """
    work = files if done is None else files.join(done.select("document_id"), "document_id", "left_anti")
    parsed = parse(work, parsers)
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    failures = parsed.filter(empty).select("document_id", "file_name", F.lit("PARSING").alias("step"), F.lit("no text").alias("error"))
    docs = parsed.filter(~empty).select("document_id", F.col("file_name").alias("document_name"), "text", "source_type", "ingested_at")
    parents, children = markdown.parent_table(docs, limits), markdown.child_table(docs, limits)
    vector = embed or (lambda title, text: vectors.hash_embedding(vectors.passage_prompt(title, text), dimensions))
    children = children.withColumn("embedding", vector(F.col("header_path"), F.col("content")))
    nodes, edges = ontology.extract(parents.select("parent_id", F.col("content").alias("text")), onto)
    entities, relations, mentions = merged_graph(parents, nodes, edges)
    return {"documents": docs.drop("text"), "parents": parents, "children": children, "failures": failures, "entities": entities, "relations": relations, "mentions": mentions}
