"""Operator 1, packing: concatenate and cut.

Pass one encodes every document once and stores its ids with its place inside its partition. Sums of the
partition totals give each partition's global offset, hence each document's. Pass two cuts the concatenation
into fixed windows; a document that crosses a window's end yields one record on each side. Records of a window
are put together to a sequence, the last one is padded, and the sequences are stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm import shared
from strataloom.llm.tokens import encoder

_CODED = "part long, before long, doc_id long, n long, ids binary"
_CUT = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Bytes of an id in what the operator returns, a little-endian number.
ID_BYTES = 4


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(part, before, doc_id, n, ids): the ids with ``end_id``, two little-endian bytes each where the vocabulary
    allows, and how many ids the same partition holds before. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=e.kind).tobytes()
        width = len(end)
        for batch in batches:
            for piece in shared.slices(batch):
                ids, at = e.encode(piece.column("text").to_pylist())
                n = np.diff(at) + 1
                raw = ids.tobytes()
                own = [raw[a:b] + end for a, b in zip((at[:-1] * width).tolist(), (at[1:] * width).tolist(), strict=True)]
                sums = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), pa.array(sums - n), piece.column("doc_id"), pa.array(n), pa.array(own, pa.binary())], ["part", "before", "doc_id", "n", "ids"])
                before = int(sums[-1])

    return shared.text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, _CODED)


def with_offsets(coded: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids before a document in all; coded must be a stored table.

    Only one row a partition, a number the input's splits bound, meets in one place."""
    totals = coded.groupBy("part").agg(F.sum("n").alias("total"))
    bases = totals.select(F.col("part").alias("base_part"), (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    # one row a partition of the input, 16 bytes each: a hundred thousand partitions make 2 MB
    return coded.join(F.broadcast(bases), coded.part == bases.base_part).withColumn("start", F.col("base") + F.col("before"))


def cut(placed: DataFrame, width: int, bytes_per_id: int) -> DataFrame:
    """One row for each piece of a document in a window, with its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch, 8 << 20, "ids"):
                out: list[list] = [[] for _ in range(7)]  # the columns of _CUT
                for doc, begin, n, raw in zip(piece.column("doc_id").to_pylist(), piece.column("start").to_pylist(), piece.column("n").to_pylist(), piece.column("ids").to_pylist(), strict=True):
                    a = 0
                    while a < n:
                        window, offset = divmod(begin + a, width)
                        b = min(n, a + width - offset)
                        for column, value in zip(out, (doc, a, b - a, n, window, offset, raw[a * bytes_per_id : b * bytes_per_id]), strict=True):
                            column.append(value)
                        a = b
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(out[-1], pa.binary())], [x.split()[0] for x in _CUT.split(", ")])

    return placed.select("doc_id", "start", "n", "ids").mapInArrow(run, _CUT)


def join_pieces(cuts: DataFrame, width: int, bytes_per_id: int, pad_id: int) -> DataFrame:
    """(sequence_id, n, ids, pieces): ``width`` ids each, of which the first ``n`` are of documents and the rest ``pad_id``.

    Ids are shuffled as stored and widened to ID_BYTES afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.full(width, pad_id, dtype="<u4").tobytes()
        for batch in batches:
            for piece in shared.slices(batch, 8 << 20, "ids"):
                wide = [np.frombuffer(x, dtype=f"<u{bytes_per_id}").astype("<u4").tobytes() for x in piece.column("ids").to_pylist()]
                ids = pa.array([x + pad[len(x) :] for x in wide], pa.binary())
                yield piece.set_column(piece.schema.get_field_index("ids"), "ids", ids)

    row = F.struct("offset", "doc_id", "start", "length", "doc_tokens", "ids")
    rows = cuts.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sort_array(F.collect_list(row)).alias("rows"))
    ids = F.aggregate("rows", F.lit(b""), lambda a, r: F.concat(a, r.ids))
    pieces = F.transform("rows", lambda r: F.struct(r.doc_id.alias("doc_id"), r.start.alias("start"), r.length.alias("length"), r.doc_tokens.alias("doc_tokens"), r.offset.alias("offset")))
    joined = rows.select("sequence_id", "n", ids.alias("ids"), pieces.alias("pieces"))
    return joined.mapInArrow(run, joined.schema)


def sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 1, width: int = 2048, pad_id: int = 0) -> DataFrame:
    """Packs all documents into sequences of ``width`` ids; all are full but the last, which is padded with ``pad_id``.

    The result is stored. ``ids`` holds four little-endian bytes an id, ``n`` how many are not padding, ``pieces`` the
    document, start in it, length, ids of the document in all, and offset in the sequence of each piece, in order.

    docs needs ``doc_id`` and ``text``; other columns are ignored. Null and empty texts hold ``end_id`` only.
    Rows that repeat a doc_id, or have none, are packed as documents of their own. An empty table gives no rows.
    The order of documents is that of the input's partitions.
    """
    from tokenizers import Tokenizer

    size = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    with shared.Tables() as t:
        coded = t.store(encode_documents(docs, tokenizer_path, end_id), "packing-ids")
        return t.result(join_pieces(cut(with_offsets(coded), width, size), width, size, pad_id), "packing-sequences")


def pieces_of(packed: DataFrame) -> DataFrame:
    """One row for each piece in stored sequences, with its own ids."""
    ids = lambda p: F.substring(F.col("ids"), (p.offset * ID_BYTES + 1).cast("int"), (p.length * ID_BYTES).cast("int"))
    rows = F.transform("pieces", lambda p: F.struct(p.doc_id.alias("doc_id"), p.start.alias("start"), p.length.alias("length"), p.doc_tokens.alias("doc_tokens"), p.offset.alias("offset"), ids(p).alias("ids")))
    return packed.select("sequence_id", F.inline(rows)).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, width: int = 2048, pad_id: int = 0) -> DataFrame:
    """The pieces of ``sequences`` of docs, each with its ids and their CRC-32."""
    return pieces_of(sequences(docs, tokenizer_path, end_id, width, pad_id)).withColumn("ids_crc32", F.crc32("ids"))
