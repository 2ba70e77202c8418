"""Quick search in titles and headings, accents and case aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T


# What a hit shows of where it was found.
PREVIEW_CHARS = 180
NO_PREVIEW, IN_PATH, IN_TEXT = "Nota cadastrada na base", "Seção em ", "Seção: "
TITLE, PATH, LINE = 1, 2, 3


def folded(text: Column) -> Column:
    """The form that is compared. Only texts beyond ASCII need folding outside the JVM, and are sent there."""
    ascii_ = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_, F.lower(text)).otherwise(T.fold(F.when(~ascii_, text)))


def entries(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every string that a search looks at: (doc_id, doc_pos, file_name, stage, pos, text, own_preview).

    Of a stored text only lines that begin with a number sign are taken out of the array of lines."""
    preview = F.col("preview") if "preview" in documents.columns else F.lit(None).cast("string")
    d = documents.select("doc_id", "doc_pos", "file_name", "markdown", preview.alias("own_preview"))
    none = F.lit(None).cast("string").alias("own_preview")
    titles = d.select("doc_id", "doc_pos", "file_name", F.lit(TITLE).alias("stage"), F.lit(0).cast("long").alias("pos"), F.col("file_name").alias("text"), "own_preview")
    paths = chunks.join(d.select("doc_id", "doc_pos", "file_name"), "doc_id").select("doc_id", "doc_pos", "file_name", F.lit(PATH).alias("stage"), F.col("pos").cast("long").alias("pos"), F.col("header_path").alias("text"), none)
    marked = F.transform(F.split("markdown", r"\r\n|\r|\n"), lambda x, i: F.struct(i.cast("long").alias("pos"), F.trim(x).alias("text")))
    lines = d.select("doc_id", "doc_pos", "file_name", F.inline(F.filter(marked, lambda x: x["text"].startswith("#")))).select("doc_id", "doc_pos", "file_name", F.lit(LINE).alias("stage"), "pos", "text", none)
    return titles.unionByName(paths).unionByName(lines)


def hits(found: DataFrame, by: list[str]) -> DataFrame:
    """Entries that hold a query as hits, the first of each document and anchor (and of each query, ``by``)."""
    text, stage = F.col("text"), F.col("stage")
    title = F.when(stage == TITLE, text).when(stage == PATH, T.header_title(text)).otherwise(F.regexp_replace(text, r"^#+\s*", ""))
    preview = F.when(stage == TITLE, F.coalesce(F.nullif(F.substring("own_preview", 1, PREVIEW_CHARS), F.lit("")), F.lit(NO_PREVIEW))).when(stage == PATH, F.concat(F.lit(IN_PATH), text)).otherwise(F.concat(F.lit(IN_TEXT), F.col("title")))
    a = found.withColumn("title", title)
    a = a.withColumns({"anchor": F.when(stage == TITLE, "").otherwise(T.anchor(F.when(stage != TITLE, F.col("title")))), "match_type": F.when(stage == TITLE, "title").otherwise("header"), "preview": preview})
    return once(a, by)


def once(hits_: DataFrame, by: list[str]) -> DataFrame:
    """The first hit of each document and anchor (and of each query, ``by``)."""
    first = Window.partitionBy(*by, "doc_id", F.when(F.col("stage") == TITLE, "title").otherwise(F.col("anchor"))).orderBy("stage", "pos")
    return hits_.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def shown(hits_: DataFrame, by: list[str] | None = None) -> DataFrame:
    return hits_.select(*(by or []), "doc_id", "file_name", "match_type", "title", "anchor", "preview")


def quick_search(documents: DataFrame, chunks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Hits in document order, not by relevance: title, then chunks' header paths, then headings of the stored text.

    documents: doc_id, doc_pos, file_name, markdown, and preview, where there is one; chunks: doc_id, pos, header_path. One hit for each document and
    anchor, the first found; ``limit`` hits in all, from 1 to 50. A query without ASCII letters after folding finds nothing.
    ``search_index`` answers the same without a scan of texts.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must be from 1 to 50")
    wanted = T.fold_text(query.strip())
    all_ = entries(documents, chunks)
    found = all_.filter(F.contains(folded(F.col("text")), F.lit(wanted))) if wanted else all_.filter("false")
    return shown(hits(found, []).orderBy("doc_pos", "stage", "pos").limit(limit))
