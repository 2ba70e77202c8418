"""Markdown to chunks: a line classifier, blocks, parent chunks packed to a limit, overlapping child chunks.

The packing is a fold whose state depends on sizes so far, so each document is folded by itself, in Arrow batches;
documents are spread over all tasks and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom import importable
from strataloom.functions import text as T

HEADING, CODE, TABLE, QUOTE, LIST, BREAK, PARAGRAPH = "heading", "code_block", "table", "blockquote", "list", "thematic_break", "paragraph"

#: What a line outside a fence is, the first pattern that fits; None ends whatever is open.
LINE_KINDS = (
    (None, re.compile(r"$")),
    (HEADING, re.compile(r"#{1,6}\s+.+$")),
    (BREAK, re.compile(r"(?:[-*_]\s*){3,}$")),
    (TABLE, re.compile(r"\|(?:.*\|)?$")),
    (QUOTE, re.compile(r">")),
    (LIST, re.compile(r"(?:[*+-]|\d+\.)\s+.+$")),
    (PARAGRAPH, re.compile(r"")),
)
ALONE = (HEADING, BREAK)
FENCES = ("```", "~~~")


@dataclass(frozen=True)
class Limits:
    parent_tokens: int = 1200
    child_tokens: int = 200
    overlap_tokens: int = 30
    token_chars: int = 4

    def tokens(self, text: str) -> int:
        return max(1, len(text) // self.token_chars) if text else 0


@dataclass
class Block:
    kind: str
    content: str
    tokens: int
    level: int = 0
    title: str = ""


def _labelled(lines: list[str]) -> Iterator[tuple[str | None, bool, str]]:
    """(kind, begins a block of its own, line); fenced lines are code, whatever they look like."""
    fence = None
    for line in lines:
        bare = line.strip()
        mark = bare[:3] if bare.startswith(FENCES) else None
        if fence:
            yield CODE, False, line
            fence = None if mark == fence else fence
        elif mark:
            fence = mark
            yield CODE, True, line
        else:
            kind = next(k for k, p in LINE_KINDS if p.match(bare))
            yield kind, kind in ALONE, line


def blocks(text: str, limits: Limits = Limits()) -> list[Block]:
    """The atomic blocks of a text: runs of lines of one kind; headings and breaks stand alone, a fence opens anew."""
    runs: list[tuple[str, list[str]]] = []
    open_ = False
    for kind, fresh, line in _labelled(text.splitlines() if text.strip() else []):
        if kind is None:
            open_ = False
        elif open_ and not fresh and runs[-1][0] == kind and kind not in ALONE:
            runs[-1][1].append(line)
        else:
            runs.append((kind, [line]))
            open_ = True
    out = []
    for kind, lines in runs:
        content = "\n".join(lines).strip()
        if kind == HEADING:
            level = len(content) - len(content.lstrip("#"))
            out.append(Block(kind, content, limits.tokens(lines[0]), level, content[level:].strip()))
        elif content:
            out.append(Block(kind, content, limits.tokens(lines[0] if kind == BREAK else content)))
    return out


def _greedy(pieces: list[str], most: int, joiner: str, extra: int = 0) -> list[str]:
    """Consecutive pieces joined while their lengths, and ``extra`` for each, stay within ``most``."""
    starts, held = [0], 0
    for i, p in enumerate(pieces):
        size = len(p) + extra
        if i > starts[-1] and held + size > most:
            starts.append(i)
            held = 0
        held += size
    return [joiner.join(pieces[a:b]).strip() for a, b in pairwise([*starts, len(pieces)])]


def split_block(text: str, limits: Limits) -> list[str]:
    """A block beyond the limit in parts: by sentences, else by lines, else by words."""
    most = limits.parent_tokens * limits.token_chars
    if len(text) <= most:
        return [text]
    for pieces, joiner in ((re.split(r"(?<=[.!?])\s+", text), " "), (text.splitlines(), "\n")):
        if len(pieces) > 1:
            return _greedy(pieces, most, joiner)
    return _greedy(text.split(), most, " ", extra=1)


@dataclass
class Parent:
    index: int
    header_path: str
    content: str
    tokens: int
    part: int | None = None
    total_parts: int | None = None


def parents(name: str, found: list[Block], limits: Limits = Limits()) -> list[Parent]:
    """Blocks packed into parents.

    A parent carries the path of headings as it stands when the parent is closed, thus with a heading that closed it.
    Until any heading came, paths count parts. A block over the limit makes parents of its own.
    """
    root = f"[Doc: {name}]"
    out: list[Parent] = []
    held: list[Block] = []
    headers: dict[int, str] = {}
    seen = False

    def path() -> str:
        return " > ".join([root, *(headers[k] for k in sorted(headers))])

    def close() -> None:
        if held:
            content, n = "\n\n".join(b.content for b in held).strip(), len(out) + 1
            out.append(Parent(n, path() if seen else f"{root} > Part {n}", content, limits.tokens(content)))
            held.clear()

    for b in found:
        if b.kind == HEADING:
            seen = True
            headers = {k: v for k, v in headers.items() if k < b.level} | {b.level: b.content}
        if b.tokens > limits.parent_tokens:
            close()
            pieces = split_block(b.content, limits)
            for k, piece in enumerate(pieces, 1):
                mark = f" (Part {k}/{len(pieces)})" if len(pieces) > 1 else ""
                out.append(Parent(len(out) + 1, path() + mark, piece, limits.tokens(piece), k, len(pieces)))
            continue
        if sum(x.tokens for x in held) + b.tokens > limits.parent_tokens:
            close()
        held.append(b)
    close()
    return out


def children(content: str, limits: Limits = Limits()) -> list[str]:
    """A parent's text in overlapping windows of whole sentences; the overlap is the sentences before that fit it."""
    most, overlap = limits.child_tokens * limits.token_chars, limits.overlap_tokens * limits.token_chars
    if len(content) <= most:
        return [content]
    out: list[str] = []
    window: list[str] = []
    size = 0
    for s in re.split(r"(?<=[.!?\n])\s+", content):
        if window and size + len(s) > most:
            out.append(" ".join(window).strip())
            back, kept = 0, len(window)
            while kept and back + len(window[kept - 1]) <= overlap:
                kept -= 1
                back += len(window[kept])
            window = window[kept:] + [s]
            size = sum(map(len, window)) + len(window)
        else:
            window.append(s)
            size += len(s)
    last = " ".join(window).strip()
    return out if out and out[-1] == last else [*out, last]


_BLOCK_SCHEMA = "document_id string, pos int, block_type string, content string, estimated_tokens int, header_level int, header_title string"
_PARENT_SCHEMA = "document_id string, document_name string, parent_id string, parent_index int, header_path string, content string, token_count int, source_type string, ingested_at double, part int, total_parts int"
_CHILD_SCHEMA = "document_id string, parent_id string, child_id string, chunk_index int, header_path string, content string, source_type string, ingested_at double"


_KINDS = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
_CHILDREN = pa.list_(pa.struct([("child_id", pa.string()), ("chunk_index", pa.int32()), ("content", pa.string())]))
#: Bytes of texts that are folded together, unless one text has more.
SLICE_BYTES = 4 << 20


def sliced(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of an Arrow batch whose texts have about SLICE_BYTES at most, or one long text."""
    total, first = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if total and total + n > SLICE_BYTES:
            yield batch.slice(first, i - first)
            total, first = 0, i
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)


def _folded(docs: DataFrame, schema: str, fold) -> DataFrame:
    importable(docs.sparkSession)
    names, kinds = zip(*[(x.strip().split()[0], x.strip().split()[1]) for x in re.split(r",\s+(?=\w+ )", schema)], strict=True)
    types = [_KINDS.get(k, _CHILDREN) for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, "text"):
                rows = [r for d in piece.to_pylist() for r in fold(d)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], list(names))

    own = docs.select(*[F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("document_id", "string"), ("document_name", "string"), ("text", "string"), ("source_type", "string"), ("ingested_at", "double"))])
    return own.mapInArrow(run, schema)


def block_table(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each block of (document_id, text)."""
    return _folded(docs, _BLOCK_SCHEMA, lambda d: [(d["document_id"], i, b.kind, b.content, b.tokens, b.level or None, b.title if b.level else None) for i, b in enumerate(blocks(d["text"] or "", limits))])


def parent_table(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each parent chunk of (document_id, document_name, text, source_type, ingested_at)."""

    def fold(d: dict) -> list[tuple]:
        found = parents(d["document_name"], blocks(d["text"] or "", limits), limits)
        return [(d["document_id"], d["document_name"], f"{d['document_id']}-p{p.index}", p.index, p.header_path, p.content, p.tokens, d["source_type"], d["ingested_at"], p.part, p.total_parts) for p in found]

    return _folded(docs, _PARENT_SCHEMA, fold)


_FAMILY = f"{_PARENT_SCHEMA}, children array<struct<child_id:string,chunk_index:int,content:string>>"


def family_table(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``parent_table``, each with its children, from one fold of each text."""

    def fold(d: dict) -> list[tuple]:
        out, n = [], 0
        for p in parents(d["document_name"], blocks(d["text"] or "", limits), limits):
            id_ = f"{d['document_id']}-p{p.index}"
            own = [{"child_id": f"{id_}-c{k}", "chunk_index": n + k - 1, "content": c} for k, c in enumerate(children(p.content, limits), 1)]
            n += len(own)
            out.append((d["document_id"], d["document_name"], id_, p.index, p.header_path, p.content, p.tokens, d["source_type"], d["ingested_at"], p.part, p.total_parts, own))
        return out

    return _folded(docs, _FAMILY, fold)


def child_table(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each child chunk; chunk_index counts through the document."""

    def fold(d: dict) -> list[tuple]:
        out: list[tuple] = []
        for p in parents(d["document_name"], blocks(d["text"] or "", limits), limits):
            for k, c in enumerate(children(p.content, limits), 1):
                out.append((d["document_id"], f"{d['document_id']}-p{p.index}", f"{d['document_id']}-p{p.index}-c{k}", len(out), p.header_path, c, d["source_type"], d["ingested_at"]))
        return out

    return _folded(docs, _CHILD_SCHEMA, fold)


_HEADING = re.compile(r"#{1,6}\s+(.+)$")
_MARK = re.compile(f"{T.PAGE_MARK}|{T.ERROR_MARK.removeprefix('(?s)')}", re.DOTALL)


def drop_repeated_headings(text: str) -> str:
    """Without a heading whose title is that of the one before it, level and case aside. Only blank lines and marks of
    pages or recognition errors may stand between them, and those before a dropped heading go with it."""
    out: list[str] = []
    last, gap = None, []
    for line in text.splitlines():
        found, bare = _HEADING.match(line), line.strip()
        if not found and (not bare or _MARK.match(bare)):
            gap.append(line)
            continue
        title = found and found[1].strip().lower()
        if found and title == last:
            gap = []
            continue
        out += [*gap, line]
        last, gap = title, []
    return "\n".join(out + gap)


def without_repeated_headings(text: Column) -> Column:
    return F.udf(lambda t: t if t is None else drop_repeated_headings(t), "string", useArrow=True)(text)


def normalized(text: Column) -> Column:
    """Recognized Markdown as one continuous text, in five steps: marks of pages go, marks of errors go, runs of blank lines
    become one, repeated headings go, outer white space goes. Null stays null."""
    return F.udf(lambda t: t if t is None else drop_repeated_headings(t).strip(), "string", useArrow=True)(T.without_marks(text))


def audio_blocks(segments: list[tuple[float, float, str]], most_seconds: float = 120.0, most_gap: float = 10.0) -> list[tuple[float, float, str]]:
    """Segments (start, end, text) in order as blocks: a new one when it would grow too long or a pause is too long."""
    out: list[list] = []
    for start, end, text in segments:
        if not (text := text.strip()):
            continue
        if out and end - out[-1][0] <= most_seconds and start - out[-1][1] <= most_gap:
            out[-1][1] = end
            out[-1][2].append(text)
        else:
            out.append([start, end, [text]])
    return [(a, b, " ".join(t)) for a, b, t in out]


def audio_block_table(segments: DataFrame) -> DataFrame:
    """(file_name, block, start, end, text) from (file_name, start, end, text): each file's segments are one row's array."""
    importable(segments.sparkSession)
    files = segments.groupBy("file_name").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("segments"))

    @F.udf("array<struct<start:double,end:double,text:string>>", useArrow=True)
    def fold(rows):
        return audio_blocks([(r["start"], r["end"], r["text"]) for r in rows])

    return files.select("file_name", F.posexplode(fold("segments")).alias("block", "b")).select("file_name", "block", "b.start", "b.end", "b.text")
