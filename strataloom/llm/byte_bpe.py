"""Operator 8, byte-level BPE: encoding with a local rank file and decoding to raw bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import shared
from strataloom.llm.tokens import rank_file, safe_starts

#: Bytes of a text beyond which it is split first, so that no call holds more.
LONG = 1 << 16


def split_long(text: str, most: int = LONG) -> list[str]:
    """Parts of about ``most`` bytes whose ids in order are the text's; without a safe place a part stays longer.

    A cut lies before white space that follows none, between words and signs, or after a lone line feed: places
    at which the pattern always ends one match and begins another.
    """
    raw = text.encode("utf-8", "replace")
    if len(raw) <= most:
        return [raw.decode()]
    safe, out, first = safe_starts(np.frombuffer(raw, dtype=np.uint8)), [], 0
    while len(raw) - first > most:
        k = np.searchsorted(safe, first + most)
        if k == len(safe):
            break
        out.append(raw[first : safe[k]].decode())
        first = int(safe[k])
    return [*out, raw[first:].decode()]


def encode(encoding, text: str) -> list[int]:
    ids: list[int] = []
    for part in split_long(text):
        ids += encoding.encode_ordinary(part)
    return ids


def encode_table(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, n_bytes): the ids of every whole text; null counts as empty. Lone surrogates become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_file(rank_path, pattern)
        for batch in batches:
            for piece in shared.slices(batch):
                ids = [encode(encoding, t) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return shared.text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, ids array<int>")


def decode_table(coded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes that the ids stand for, which need not be whole characters; null where ids are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_file(rank_path, pattern)
        for batch in batches:
            for piece in shared.slices(batch, column="ids"):
                data = [None if x is None else encoding.decode_bytes(x) for x in piece.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids, one text at a time.

    Null and empty texts have no ids. Repeated rows give repeated rows, an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_file(rank_path, pattern)
        words = [str(i) for i in range(encoding.n_vocab)]
        for batch in batches:
            for piece in shared.slices(batch):
                n, coded, decoded = [], [], []
                for text in piece.column("text").to_pylist():
                    ids = encode(encoding, text)
                    n.append(len(ids))
                    coded.append(hashlib.sha256(" ".join(map(words.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return shared.text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
