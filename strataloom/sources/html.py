"""Files that need no model to text: HTML, CSV, JSON and plain text, with the standard library in Arrow batches."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom import importable
from strataloom.functions import text as T

SKIPPED = {"script", "style", "nav", "template", "noscript", "head"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "table", "tr", "article", "section", "header", "footer", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list[str]] = [[]]
        self.skipped: list[str] = []
        self.prefix = ""

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped.append(tag)
        elif tag in BLOCKS and not self.skipped:
            self.prefix = "#" * int(tag[1]) + " " if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else "- " if tag == "li" else ""
            self.lines.append([self.prefix] if self.prefix else [])

    def handle_endtag(self, tag):
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass
        elif tag in BLOCKS and not self.skipped:
            self.lines.append([])

    def handle_data(self, data):
        if not self.skipped:
            self.lines[-1].append(data)


def to_markdown(html: str) -> str:
    """Headings, list items and paragraphs, one to a line with a blank line between; scripts and navigation go."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    lines = [" ".join("".join(x).split()) for x in reader.lines]
    return "\n\n".join(x for x in lines if x.strip("#- "))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text) from (page_id, html); null becomes an empty text."""
    importable(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [to_markdown(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string")


def table_text(text: str) -> str:
    """CSV as a Markdown table; rows are filled or cut to the first one's width."""
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        return ""
    width = len(rows[0])
    line = lambda r: "| " + " | ".join(x.strip().replace("|", "\\|").replace("\n", " ") for x in (r + [""] * width)[:width]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def file_text(content: bytes, ending: str) -> str:
    """A file's text by its ending; bytes are UTF-8, else Latin-1. What can't be read as its kind is plain text."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    convert = {".html": to_markdown, ".htm": to_markdown, ".csv": table_text}.get(ending)
    try:
        found = convert(text) if convert else text
    except (csv.Error, ValueError, AssertionError):
        found = ""
    return found if found.strip() else text


def fast_texts(files: DataFrame) -> DataFrame:
    """files (file_name, content_type, content, ...) with text; office files and PDF need a parser of the caller's."""
    importable(files.sparkSession)
    ending = next(n for k in range(len(files.columns) + 1) if (n := f"__ending{k}") not in files.columns)  # a name that is free
    with_ending = files.withColumn(ending, T.ending_of(F.col("content_type"), F.col("file_name")))
    schema = files.withColumn("text", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if c is None else file_text(c, e) for c, e in zip(batch.column("content").to_pylist(), batch.column(ending).to_pylist(), strict=True)]
            names = [n for n in batch.schema.names if n != ending]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, "text"])

    return with_ending.mapInArrow(run, schema)
