"""Operator 13, best-fit packing: bounded-space online best fit.

A task meets its documents one by one and holds a fixed number of open sequences. A bitset has a bit for each amount
of free space that some open sequence has, so the sequence with the least room that still fits a piece is found by one
shift and the lowest set bit. A piece that fits nowhere opens a sequence; when the number is reached, the fullest one
closes first. A document is cut only if it is longer than a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import shared
from strataloom.llm.packing import ID_BYTES
from strataloom.llm.tokens import encoder

#: Open sequences of a task, at most; each holds less than its width of ids.
OPEN = 256
#: A sequence's number has its task's above so many bits.
TASK_BITS = 40
#: Bytes of ids of closed sequences that leave a task at once.
BATCH_BYTES = 4 << 20

_PIECE = "doc_id: bigint, piece: int, start: bigint, length: bigint, doc_tokens: bigint, offset: bigint"
_SEQUENCE = f"sequence_id bigint, n bigint, ids binary, pieces array<struct<{_PIECE}>>"
_ARROW = pa.schema([
    ("sequence_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()),
    ("pieces", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())]))),
])


class OpenBins:
    """The open bins of one task, each a list of items; ``put`` returns the bins that close by it."""

    def __init__(self, width: int, most: int):
        self.width, self.most, self.count = width, most, 0
        self.free = 0  # bit f is set if some bin has f places free
        self.by_free: list[list[list]] = [[] for _ in range(width + 1)]

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.free ^= 1 << free
        self.count -= 1
        return out

    def put(self, size: int, item) -> list[list]:
        closed = []
        fitting = self.free >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(room)
        else:
            room, bin_ = self.width, []
            if size < self.width and self.count == self.most:
                closed.append(self._take((self.free & -self.free).bit_length() - 1))
        bin_.append(item)
        left = room - size
        if left:
            self.by_free[left].append(bin_)
            self.free |= 1 << left
            self.count += 1
        else:
            closed.append(bin_)
        return closed

    def rest(self) -> Iterator[list]:
        """All bins that are open, the fullest first."""
        while self.free:
            yield self._take((self.free & -self.free).bit_length() - 1)


def pieces_of_length(n: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or full ones after a first that may be shorter."""
    first = n if n <= width else n % width or width
    return [(0, first), *((a, width) for a in range(first, n, width))]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, width: int = 1024, most_open: int = OPEN, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n, ids, pieces): sequences of ``width`` ids, the first ``n`` of documents and the rest ``pad_id``.

    ``ids`` holds four little-endian bytes an id; ``pieces`` the document, the piece's number, its start in the document,
    length, the document's ids in all, and its offset in the sequence. One pass without a shuffle; a task's memory is
    its open sequences. Which documents meet depends on the input's partitions, so store the result to read it twice
    if these may change; a task that runs again gives the same rows.

    docs needs ``doc_id`` and ``text``; other columns are ignored. Null and empty texts hold ``end_id`` only. Rows that
    repeat a doc_id, or have none, are documents of their own. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, bins, made = encoder(tokenizer_path), OpenBins(width, most_open), TaskContext.get().partitionId() << TASK_BITS
        pad = np.full(width, pad_id, dtype="<u4").tobytes()
        rows: list[tuple] = []

        def close(bin_: list) -> None:
            nonlocal made
            offset, out = 0, []
            for doc, piece, start, length, n, _ in bin_:
                out.append((doc, piece, start, length, n, offset))
                offset += length
            ids = b"".join(x[-1] for x in bin_)
            rows.append((made, offset, ids + pad[len(ids) :], out))
            made += 1

        def batch_of() -> pa.RecordBatch:
            names = [f.name for f in _ARROW.field("pieces").type.value_type]
            columns = [[r[k] for r in rows] for k in range(3)]
            pieces = [[dict(zip(names, p, strict=True)) for p in r[3]] for r in rows]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, pieces], _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for part in shared.slices(batch):
                ids, at = e.encode(part.column("text").to_pylist())
                wide = ids.astype("<u4").tobytes()
                end = np.array([end_id], dtype="<u4").tobytes()
                for doc, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    raw, n = wide[a * ID_BYTES : b * ID_BYTES] + end, b - a + 1
                    for k, (start, length) in enumerate(pieces_of_length(n, width)):
                        for bin_ in bins.put(length, (doc, k, start, length, n, raw[start * ID_BYTES : (start + length) * ID_BYTES])):
                            close(bin_)
                        if len(rows) * width * ID_BYTES >= BATCH_BYTES:
                            yield batch_of()
        for bin_ in bins.rest():
            close(bin_)
            if len(rows) * width * ID_BYTES >= BATCH_BYTES:
                yield batch_of()
        if rows:
            yield batch_of()

    return shared.text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, _SEQUENCE)


def pieces_of(packed: DataFrame) -> DataFrame:
    """One row for each piece, with its own ids."""
    own = lambda p: F.substring(F.col("ids"), (p.offset * ID_BYTES + 1).cast("int"), (p.length * ID_BYTES).cast("int"))
    names = ["doc_id", "piece", "start", "length", "doc_tokens", "offset"]
    rows = F.transform("pieces", lambda p: F.struct(*[p[x].alias(x) for x in names], own(p).alias("ids")))
    return packed.select("sequence_id", F.inline(rows))


def digests(packed: DataFrame) -> DataFrame:
    """The pieces of packed sequences with the CRC-32 of their ids in place of the ids."""
    return pieces_of(packed).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "doc_tokens")
