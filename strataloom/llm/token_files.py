"""Operator 9, token-ID files: independent zstandard frames, a trailing seek table and per-frame checksums.

A shard file is a row of zstandard frames, each with its content size and checksum, then one skippable frame
with the index of documents, then the seek table in its public form: a skippable frame (magic 0x184D2A5E) with,
for each frame before it, compressed size, decompressed size and the low 32 bits of XXH64 of the content, and at
the end the number of frames, a descriptor byte and the magic 0x8F92EAB1, all little-endian. The frames' contents
are ids of four bytes each. A document lies in one frame, so a reader fetches the seek table, the index, and only
the frames of the documents it wants. Any zstandard reader can decompress the whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm import shared
from strataloom.llm.tokens import encoder

# Fixed values of the file format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Bytes of ids in a frame, unless one document has more.
FRAME_BYTES = 1 << 18
#: Bytes of ids in a shard file.
SHARD_BYTES = 64 << 20
#: Bytes of text that are encoded at once: arrays of some hundred bytes for each go with it.
SLICE_BYTES = 1 << 20
#: Partitions of the ordered pass: one for so many bytes of text, and their most.
PART_BYTES = 128 << 20
MOST_PARTS = 100_000
#: Characters of a text by which rows that share a doc_id, or have none, are told to different partitions.
PREFIX = 64
_MANIFEST = "part long, shard long, path string, docs long, ids long"
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "<u1"), ("frame", "<u4"), ("first", "<u8"), ("n", "<u8")])


class Writer:
    """Writes one shard. ``sink`` is any object with write()."""

    def __init__(self, sink, level: int = 3):
        import zstandard

        self.sink, self.table, self.index, self.held, self.size = sink, [], [], [], 0
        self.coder = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.size + 4 * len(ids) > FRAME_BYTES:
            self._flush()
        self.index.append((doc_id or 0, doc_id is None, len(self.table), self.size // 4, len(ids)))
        self.held.append(ids.astype("<u4").tobytes())
        self.size += 4 * len(ids)
        self.ids += len(ids)

    def _flush(self) -> None:
        import xxhash

        data = b"".join(self.held)
        coded = self.coder.compress(data)
        self.sink.write(coded)
        self.table.append((len(coded), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        import xxhash

        if self.held:
            self._flush()
        content = self.coder.compress(np.array(self.index, dtype=_INDEX).tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(content)) + content)
        self.table.append((len(content) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE))


class Reader:
    """Reads documents of one shard. ``source`` is a seekable file object."""

    def __init__(self, source):
        import zstandard

        self.source, self.decoder = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2)
        source.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        source.seek(end - 9 - 12 * frames)
        table = np.frombuffer(source.read(12 * frames), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.table = table[:-1]
        self.at = np.concatenate(([0], np.cumsum(table[:, 0])))
        source.seek(int(self.at[-2]))
        raw = source.read(int(table[-1, 0]))
        self.index = np.frombuffer(self.decoder.decompress(raw[8:]), dtype=_INDEX)

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        self.source.seek(int(self.at[k]))
        data = self.decoder.decompress(self.source.read(int(self.table[k, 0])))
        if len(data) != self.table[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, dtype="<u4")

    def documents(self, wanted=None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in order, of all documents or of a set of doc_ids; only their frames are read."""
        rows = self.index if wanted is None else self.index[np.isin(self.index["doc_id"], list(wanted)) & (self.index["null"] == 0)]
        at, ids = -1, None
        for doc, null, k, first, n in rows.tolist():
            if k != at:
                at, ids = k, self.frame(k)
            yield None if null else doc, ids[first : first + n]


def open_store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write(docs: DataFrame, tokenizer_path: str, end_id: int, at: str) -> DataFrame:
    """Writes the shards in ascending doc_id (null first; rows of one doc_id by text) under ``at``.

    Returns the stored manifest: part, shard, path, docs, ids. A shard's name holds an id of its task's attempt,
    so an attempt that failed leaves a file that no manifest row names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        store, base = open_store(at)
        store.create_dir(base, recursive=True)
        writer, shard, rows, out = None, 0, 0, None
        name = ""

        def finish():
            writer.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, shard, f"{at}/{name}", rows, writer.ids)], ["part", "shard", "path", "docs", "ids"])

        for batch in batches:
            for piece in shared.slices(batch, SLICE_BYTES):
                ids, bounds = e.encode(piece.column("text").to_pylist())
                for doc, a, b in zip(piece.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if writer and 4 * writer.ids >= SHARD_BYTES:
                        yield finish()
                        writer, shard, rows = None, shard + 1, 0
                    if not writer:
                        name = f"ids-{part:06d}-{shard:04d}-{uuid.uuid4().hex}.zst"
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                        writer = Writer(out)
                    writer.add(doc, np.append(ids[a:b], e.kind(end_id)))
                    rows += 1
        if writer:
            yield finish()

    ordered = shared.text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    parts = shared.parts_of(ordered, PART_BYTES, MOST_PARTS)
    ordered = ordered.repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.substring("text", 1, PREFIX)).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return shared.materialize(ordered.mapInArrow(run, _MANIFEST), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards frame by frame.

    ``start`` counts the ids of all documents before it, from the shards' totals; one row a shard meets in one place.
    """
    bases = manifest.withColumn("base", F.sum("ids").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, inside = open_store(path)
                with store.open_input_file(inside) as f:
                    docs, starts, sizes, sums, at = [], [], [], [], base
                    for doc, ids in Reader(f).documents():
                        docs.append(doc)
                        starts.append(at)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids))
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, sizes, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task reads the files of one writer, or of a few
    files = bases.select("path", "base", "part")
    return files.repartition("part").select("path", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """The round trip over all documents, by files in the shared folder.

    Null and empty texts hold ``end_id`` only. Rows that repeat a doc_id are documents of their own. An empty
    table gives no files and no rows.
    """
    return read(write(docs, tokenizer_path, end_id, shared.new_path(docs.sparkSession, "token-files")))
