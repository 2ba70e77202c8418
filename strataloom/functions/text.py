"""Text expressions: token estimates, names, anchors, headings, Markdown clean-up. Columns in, columns out."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters a token, as the chunker counts and as the query budget counts.
CHUNK_CHARS = 4
BUDGET_CHARS = 3.3


def chunk_tokens(text: Column) -> Column:
    """0 for an empty text, else a quarter of its characters, 1 at least."""
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / CHUNK_CHARS).cast("int"))).cast("int")


def budget_tokens(text: Column) -> Column:
    """0 for an empty or null text, else characters by 3.3, rounded up."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n / F.lit(BUDGET_CHARS)))).cast("int")


def identifier(name: Column, upper: bool = False) -> Column:
    """A graph label: anything but ASCII letters, digits and underscores becomes an underscore; empty: Entity."""
    clean = F.regexp_replace(F.upper(name) if upper else name, "[^a-zA-Z0-9_]", "_")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("Entity")).otherwise(clean)


def field_name(name: Column) -> Column:
    """An attribute's name: as a label, but a leading digit gets a prefix."""
    clean = F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("Field_"), clean)).otherwise(clean)


def graph_name(kb_id: Column) -> Column:
    return F.concat(F.lit("kb_"), F.replace(kb_id, F.lit("-"), F.lit("_")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(name: Column) -> Column:
    """A file name's ending in lower case, empty without one; a leading dot begins no ending."""
    return F.coalesce(F.regexp_extract(F.lower(name), r"[^/](\.[^./]+)$", 1), F.lit(""))


def clock(seconds: Column) -> Column:
    """mm:ss, minutes unbounded."""
    whole = F.floor(seconds).cast("long")
    minutes = F.floor(whole / 60).cast("string")
    return F.concat(F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def snake_case(name: Column) -> Column:
    first = F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(first, "([a-z0-9])([A-Z])", "$1_$2"))


# What a MIME type, else a file name's ending, says about a source.
DOCUMENT_MIMES = (
    "application/pdf",
    "application/json",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/x-subrip",
)
AUDIO_ENDINGS = (".mp3", ".m4a", ".ogg", ".opus", ".oga", ".webm", ".wav", ".aac", ".caf", ".amr", ".3gp")
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".webp", ".heic", ".heif")


def source_type(mime: Column, file_name: Column) -> Column:
    """audio, image or document: by MIME type where it tells, else by the name's ending."""
    m = F.lower(F.trim(F.coalesce(mime, F.lit(""))))
    ending = suffix(file_name)
    by_mime = F.when(m.startswith("image/"), "image").when(m.startswith("audio/") | (m == "video/3gpp"), "audio").when(m.startswith("text/") | m.isin(*DOCUMENT_MIMES), "document")
    by_name = F.when(ending.isin(*IMAGE_ENDINGS), "image").when(ending.isin(*AUDIO_ENDINGS), "audio").otherwise("document")
    return F.coalesce(by_mime, by_name)


# The ending that a MIME type stands for, where a file name has none, and that of all other types.
ENDINGS = {
    "text/plain": ".txt",
    "text/markdown": ".md",
    "text/html": ".html",
    "application/pdf": ".pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "text/csv": ".csv",
    "application/json": ".json",
}
OTHER_ENDING = ".txt"


def ending_of(mime: Column, file_name: Column) -> Column:
    """A file's own ending, else that of its MIME type."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), F.lower(mime))
    return F.coalesce(F.nullif(suffix(file_name), F.lit("")), known, F.lit(OTHER_ENDING))


def utc_time(seconds: Column) -> Column:
    """Epoch seconds as a UTC time; N/A where unknown. The session's zone must be UTC."""
    return F.coalesce(F.concat(F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), F.lit("N/A"))


# Patterns of tables, headings and figures in Markdown, of page marks, and of words in names.
def structure_counts(text: Column) -> dict[str, Column]:
    """Table delimiters, headings and figure marks of a Markdown text."""
    return {
        "tables": F.regexp_count(text, F.lit(r"\|[-:\s]+\|")).cast("long"),
        "headings": F.regexp_count(text, F.lit(r"(?m)^#{1,4}\s+.+$")).cast("long"),
        "figures": F.regexp_count(text, F.lit(r"(?i)(?:>\s*\*\*\[Figura|\[Figura\s*\d+)")).cast("long"),
    }


def snippet(text: Column, most: int = 200) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def lineage(*titles: str) -> Column:
    """The open sections of a page in one line, shallowest first; absent levels are skipped."""
    return F.concat_ws(" -> ", *[F.col(t) for t in titles])


def words_and_margin(text: Column) -> Column:
    """Tokens of a request: its words and a margin of 500."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) + 500


def payload_tokens(content: Column) -> Column:
    """Tokens of a request of so many bytes: a quarter, 1 at least; 100 without content."""
    n = F.coalesce(F.octet_length(content), F.lit(0))
    return F.when(n == 0, 100).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def snippets(contents: Column, most: int = 200) -> Column:
    """The beginnings of passages, one a line."""
    return F.array_join(F.transform(contents, lambda c: F.concat(F.lit("- "), F.substring(c, 1, most))), "\n")


def appended(array_text: Column, item: Column) -> Column:
    """A JSON array with one more item; null counts as empty."""
    inner = F.regexp_extract(F.coalesce(array_text, F.lit("[]")), r"(?s)^\s*\[(.*)\]\s*$", 1)
    return F.concat(F.lit("["), F.when(F.trim(inner) == "", item).otherwise(F.concat(inner, F.lit(","), item)), F.lit("]"))


def field_or(variant: Column, path: str, kind: str, default: object = None) -> Column:
    """A JSON value's field; a default, where given, in place of null."""
    found = F.try_variant_get(variant, path, kind)
    return found if default is None else F.coalesce(found, F.lit(default))


def json_part(reply: Column) -> Column:
    """The JSON array of a reply: the one that a fence holds, whatever words follow it, else the outermost one; null
    without any."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), F.lit("")))


def fold_text(text: str) -> str:
    """Accents and all else beyond ASCII removed, lower case."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()


def anchor_text(text: str) -> str:
    kept = re.sub(r"[^\w\s-]", "", fold_text(text)).strip()
    return re.sub(r"[-\s]+", "-", kept) or "section"


def _each(function):
    """A column function that applies a text function in Arrow batches. It is made when called, in the driver."""

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return lambda column: F.pandas_udf(batch, StringType())(column)


#: Accent-insensitive form for matching. Spark has no Unicode decomposition.
fold = _each(fold_text)
#: A heading's anchor in a page.
anchor = _each(anchor_text)


def header_title(path: Column) -> Column:
    """The last part of a path of headings, without its number signs."""
    parts = F.filter(F.transform(F.split(path, ">"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(path)
    return F.regexp_replace(last, r"^#+\s*", "")


def headings(text: Column) -> Column:
    """The headings of a Markdown text in order: array of (pos, level, title). Fences aren't looked at."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x))
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.length(F.regexp_extract(x, r"^(#{1,6})\s+.+$", 1)).alias("level"), F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1).alias("title")))
    return F.filter(marked, lambda h: h["level"] > 0)


# Marks of pages and of recognition errors, as patterns that Python and Java read alike.
PAGE_MARK = r"<!--\s*PAGE\s*\d+\s*-->"
ERROR_MARK = r"(?s)<!--\s*\[Erro no OCR.*?\]\s*-->"


def without_marks(text: Column) -> Column:
    """Page marks and recognition errors removed, runs of blank lines made one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, PAGE_MARK, ""), ERROR_MARK, ""), r"\n{3,}", "\n\n")


def clean_markdown(text: Column) -> Column:
    """The same, outer white space trimmed. ``operators.markdown.normalized`` drops repeated headings too."""
    return F.regexp_replace(without_marks(text), r"^\s+|\s+$", "")
