"""Operator 3, quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score's pairwise part is sum over f of ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2) / 2, so it takes time in
proportion to a text's distinct words. Metadata means what any text carries, its length in code points; the table's
labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import labelled, shared

WORD_BITS = 14
RANK = 8
#: Most labelled rows that the fit uses.
MOST_ROWS = 10_000
#: Most bytes of their features, so that the driver holds them whatever the texts' lengths.
MOST_BYTES = 96 << 20
#: They reach the driver in parts of so many bytes, about, of which its JVM holds one at a time.
PART_BYTES = 4 << 20
#: Passes over the rows at least, and steps of 64 rows at least.
EPOCHS, STEPS = 12, 1500
THRESHOLD = 0.7

#: Bounds of the bins of each statistic; a text has one of nine features for each.
EDGES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
STATISTICS = ("symbols", "exclamations", "capitals", "digits", "signs", "word_length", "distinct", "doubled", "repeated_lines", "line_words", "words", "chars")
DIMENSIONS = (1 << WORD_BITS) + len(STATISTICS) * (len(EDGES) + 1)


def _flags(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[np.frombuffer(characters.encode(), dtype=np.uint8)] = 1
    return table


_SYMBOL, _EXCLAIM, _UPPER = _flags("#*$%&|<>~^=_\\{}[]@"), _flags("!"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER, _DIGIT = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), _flags("0123456789")
_SIGN = _flags("\"'(),-./:;?`")


def statistics(texts: list[str], hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of values for each text, mostly shares between 0 and 1."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    starts = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    count = lambda table: np.add.reduceat(table[data], starts, dtype=np.int64)
    words, letters = np.maximum(np.diff(at), 1), np.maximum(count(_LETTER), 1)
    chars = np.array([len(t) for t in texts])
    same = np.zeros(len(hashes) + 1)
    same[1 : len(hashes)] = hashes[1:] == hashes[:-1]
    sums = np.concatenate(([0], np.cumsum(same)))
    doubled = np.maximum(sums[np.maximum(at[1:], at[:-1])] - sums[np.minimum(at[:-1] + 1, at[1:])], 0)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)])
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    n_lines = np.maximum([len(x) for x in lines], 1)
    repeated = n_lines - np.maximum([len(set(x)) for x in lines], 1)
    columns = (
        count(_SYMBOL) / words, count(_EXCLAIM) / words, count(_UPPER) / letters, count(_DIGIT) / np.maximum(chars, 1), count(_SIGN) / words / 2,
        chars / words / 20, distinct / words, doubled / words, repeated / n_lines, words / n_lines / 200, np.log10(words) / 5, np.log10(np.maximum(chars, 1)) / 6,
    )
    return np.stack(columns, axis=1)


def features(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Indices and values of each text's features: words of unit length together, each statistic's bin with value 1."""
    hashes, at = shared.word_hashes(texts)
    stats = statistics(texts, hashes, at)
    bins = (1 << WORD_BITS) + np.arange(len(STATISTICS)) * (len(EDGES) + 1) + np.searchsorted(EDGES, stats, side="right")
    indices, values = [], []
    for row, a, b in zip(bins, at[:-1], at[1:], strict=True):
        slots, counts = np.unique((hashes[a:b] >> np.uint64(64 - WORD_BITS)).astype(np.int32), return_counts=True)
        x = np.log1p(counts)
        indices.append(np.concatenate((slots, row.astype(np.int32))))
        values.append(np.concatenate((x / max(np.linalg.norm(x), 1e-9), np.full(len(row), 0.5))).astype(np.float32))
    return indices, values


@dataclass
class Machine:
    """The fitted numbers: a bias, a weight and a row of factors for each feature."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, indices: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        squares = self.factors**2
        out = np.empty(len(indices))
        for k, (i, x) in enumerate(zip(indices, values, strict=True)):
            s = x @ self.factors[i]
            out[k] = self.bias + x @ self.weights[i] + 0.5 * (s @ s - ((x * x) @ squares[i]).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(indices: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, seed: int = 1) -> Machine:
    """Logistic loss, AdaGrad over small batches in a fixed order. Without rows of both labels: the smoothed share of 1."""
    rng = np.random.Generator(np.random.PCG64(seed))
    share = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(DIMENSIONS), rng.normal(0, 0.05, (DIMENSIONS, RANK)))
    if not len(y) or y.min() == y.max():
        m.factors[:] = 0
        return m
    seen_w, seen_v, rate, decay = np.full(DIMENSIONS, 0.1), np.full((DIMENSIONS, RANK), 0.1), 0.2, 1e-4
    for _ in range(max(EPOCHS, -(-STEPS * 64 // len(y)))):
        order = rng.permutation(len(y))
        for first in range(0, len(y), 64):
            rows = order[first : first + 64]
            i = np.concatenate([indices[r] for r in rows])
            x = np.concatenate([values[r] for r in rows]).astype(np.float64)
            starts = np.cumsum([0] + [len(indices[r]) for r in rows[:-1]])
            of = np.repeat(np.arange(len(rows)), [len(indices[r]) for r in rows])
            v = m.factors[i]
            xv = v * x[:, None]
            s = np.add.reduceat(xv, starts)
            margin = m.bias + np.add.reduceat(m.weights[i] * x, starts) + 0.5 * ((s**2).sum(axis=1) - np.add.reduceat((xv**2).sum(axis=1), starts))
            g = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]
            gx = (g[of] * x)[:, None]
            touched, back = np.unique(i, return_inverse=True)
            grad_w = np.bincount(back, weights=gx[:, 0]) / len(rows) + decay * m.weights[touched]
            each = gx * (s[of] - xv)
            grad_v = np.stack([np.bincount(back, weights=each[:, f]) for f in range(RANK)], axis=1) / len(rows) + decay * m.factors[touched]
            seen_w[touched] += grad_w**2
            seen_v[touched] += grad_v**2
            m.weights[touched] -= rate * grad_w / np.sqrt(seen_w[touched])
            m.factors[touched] -= rate * grad_v / np.sqrt(seen_v[touched])
            m.bias -= rate * g.mean() * 0.1
    return m


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, most: int = MOST_ROWS) -> Machine:
    """Fits on ``labels.quality`` of at most ``most`` documents outside the held-out fold, and at most MOST_BYTES of
    features; equal texts count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch):
                i, x = features(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), pa.array([a.tobytes() for a in i], pa.binary()), pa.array([a.tobytes() for a in x], pa.binary())], ["doc_id", "y", "i", "x"])

    with shared.Tables() as t:
        found = labelled.sample(docs, labels, "quality", modulus, remainder, most).select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, i binary, x binary")
        rows = labelled.within_bytes(t.store(found, "quality-features"), F.octet_length("i") + F.octet_length("x"), MOST_BYTES)
        rows = list(rows.repartition(MOST_BYTES // PART_BYTES).toLocalIterator())
    rows = {(r.i, r.x): r for r in sorted(rows, key=lambda r: -r.doc_id)}.values()
    rows = sorted(rows, key=lambda r: r.doc_id)
    return fit([np.frombuffer(r.i, dtype=np.int32) for r in rows], [np.frombuffer(r.x, dtype=np.float32) for r in rows], np.array([r.y for r in rows], dtype=np.float64))


def score_texts(machine: Machine, texts: list[str]) -> np.ndarray:
    return machine.score(*features(texts))


def score(docs: DataFrame, machine: Machine, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null and empty texts get the score of a text without words. Repeated rows give repeated rows, an empty table
    none; a row without doc_id is scored and counts as held out. Extra columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score_texts(model.value, piece.column("text").to_pylist()))], ["doc_id", "score"])

    out = shared.text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", labelled.held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents that score THRESHOLD or more, with all their columns.

    Null and empty texts get the score of a text without words. Repeated rows share their fate, rows without doc_id are
    scored like others, an empty table stays empty."""
    return shared.keep_scored(docs, lambda texts, m: score_texts(m, texts), machine, lambda s: s >= THRESHOLD)
