"""Nearest chunks for many query vectors, exactly by blocks or through an inverted file of vectors.

Both ways bring bounded groups of queries and of chunks together by a shuffle, keep k rows for each query and group, and
merge those. A vector that is null, empty, zero or of another length than most is near nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom import importable
from strataloom.functions import vectors

#: Bytes of vectors, four a number, of a group of chunks and of a group of queries that meet in one task.
CHUNK_BYTES = 32 << 20
QUERY_BYTES = 8 << 20
#: Scores that a task holds at once.
SCORES = 4 << 20
#: Rows on which an index is fitted, at most, and its most lists.
SAMPLE_ROWS = 20_000
MOST_LISTS = 4096
#: Share of the true neighbours that the number of probed lists is chosen for, on the sample.
TARGET = 0.95
#: Fewest chunks of a list, on average.
LIST_ROWS = 20
#: Two scores that differ by less are compared again in one fixed order of additions.
CLOSE = 1e-9

_FOUND = "query_id long, child_id long, parent_id long, score double"


# blocks


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def best_of(queries: np.ndarray, chunks: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places of its k best chunks, scores): by score, then id. The product of matrices only finds candidates;
    equal vectors must score alike wherever they stand, so candidates are scored again row by row."""
    chunk_norms, query_norms = _norms(chunks), _norms(queries)
    step = max(1, SCORES // max(1, len(chunks)))
    for a in range(0, len(queries), step):
        scores = queries[a : a + step] @ chunks.T / (query_norms[a : a + step, None] * chunk_norms[None, :])
        for q in range(len(scores)):
            row = scores[q]
            least = np.partition(row, len(row) - k)[len(row) - k] - CLOSE if len(row) > k else -np.inf
            at = np.flatnonzero(row >= least)
            exact = (chunks[at] * queries[a + q]).sum(axis=1) / (chunk_norms[at] * query_norms[a + q])
            order = np.lexsort((ids[at], -exact))[:k]
            yield a + q, at[order], exact[order]


def _meet(queries: DataFrame, chunks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each query, over all groups in which it meets chunks."""

    def pairs(q: pa.Table, c: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        if q.num_rows and c.num_rows:
            query_ids = q.column("query_id").to_numpy()
            ids, parents = c.column("child_id").to_numpy(), c.column("parent_id").to_numpy()
            for i, at, scores in best_of(_matrix(q.column("vector")), _matrix(c.column("embedding")), ids, k):
                for column, values in zip(columns, (np.full(len(at), query_ids[i]), ids[at], parents[at], scores), strict=True):
                    column.append(values)
        made = [np.concatenate(x) if x else np.empty(0, dtype=np.float64 if n == 3 else np.int64) for n, x in enumerate(columns)]
        return pa.table(made, names=["query_id", "child_id", "parent_id", "score"])

    met = queries.groupBy(*keys).cogroup(chunks.groupBy(*keys)).applyInArrow(pairs, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "child_id")
    # each task cuts its rows to k a query before they are shuffled
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _fit(df: DataFrame, column: str, dimensions: int) -> DataFrame:
    return df.filter((F.size(column) == dimensions) & F.coalesce(vectors.norm(F.col(column)) > 0, F.lit(False)))


def dimensions_of(df: DataFrame, column: str) -> tuple[int, int]:
    """(length of most vectors, number of rows); of two lengths as frequent the smaller."""
    sizes = df.filter(F.size(column) > 0).groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return (sizes[0].d, sizes[0].n) if sizes else (0, 0)


def nearest_many(children: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, child_id, parent_id, score, rank): of each query (query_id, vector), unique by id, its k nearest children.

    Every query meets every child, in groups: chunks go to as many tasks as their bytes need, once for each group of
    queries. Nothing of either side passes through the driver but two counts.
    """
    importable(children.sparkSession)
    d, n = dimensions_of(children, "embedding")
    many = queries.count()
    tasks = int(children.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(-(-n * d * 4 // CHUNK_BYTES), min(tasks, -(-n // 4096)), 1)
    groups = max(1, -(-many * d * 4 // QUERY_BYTES))
    c = _fit(children, "embedding", d).select(F.col("child_id").cast("long"), F.col("parent_id").cast("long"), F.col("embedding").cast("array<double>"), F.pmod(F.xxhash64("child_id"), F.lit(pieces)).alias("piece"))
    q = _fit(queries, "vector", d).select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part"))
    c = c.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"))
    q = q.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("piece"))
    return _meet(q, c, ["part", "piece"], k)


# inverted file


def _means(rows: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means over unit rows, begun from rows that are spread over the sample."""
    centres = rows[np.linspace(0, len(rows) - 1, lists).astype(np.int64)]
    for _ in range(rounds):
        near = np.concatenate([(rows[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(rows), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        length = _norms(sums)
        centres = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centres)
    return centres


def _probes(rows: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """The fewest lists, nearest first, that hold ``target`` of the k nearest rows of the sample's first rows."""
    asked = rows[: min(len(rows), 256)]
    near = (rows @ centres.T).argmax(axis=1)
    order = np.argsort(-(asked @ centres.T), axis=1)
    place = np.argsort(order, axis=1)
    top = np.argpartition(-(asked @ rows.T), min(k, len(rows)) - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(place, near[top], axis=1).reshape(-1))
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


@dataclass(frozen=True)
class Index:
    """A stored inverted file. ``centres`` (list, centre, rows, reach): the unit centre, how many children the list has and
    the least cosine of one of them with the centre. ``probes``: lists that a search reads unless told otherwise."""

    path: str
    dimensions: int
    probes: int

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")

    def centres(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/centres")


def build(children: DataFrame, path: str, k: int = 50, target: float = TARGET, lists: int | None = None) -> Index:
    """Fits centres on a sample and stores every child with the list of its nearest centre, a folder for each list.

    The sample is bounded: the SAMPLE_ROWS children whose ids hash least. Its vectors come to the driver, and how many
    lists a search must read for ``target`` of its k nearest is measured on it. A list that many children share is
    spread over files by their bytes. An empty table makes an index without lists.
    """
    spark = children.sparkSession
    importable(spark)
    d, n = dimensions_of(children, "embedding")
    fit = _fit(children, "embedding", d).select(F.col("child_id").cast("long"), F.col("parent_id").cast("long"), F.col("embedding").cast("array<double>"))
    sample = fit.orderBy(F.xxhash64("child_id"), "child_id").select("embedding").limit(SAMPLE_ROWS).toPandas()["embedding"]
    rows = np.array([np.asarray(x) for x in sample]).reshape(len(sample), d)
    rows = rows / np.maximum(_norms(rows), 1e-300)[:, None] if len(rows) else rows
    lists = max(1, min(lists or int(n**0.5), MOST_LISTS, max(1, len(rows) // LIST_ROWS)))
    centres = _means(rows, lists) if len(rows) else np.zeros((0, d))
    scaled = max(1, min(k, round(k * len(rows) / max(1, n)))) if len(rows) else 1
    probes = _probes(rows, centres, max(scaled, min(k, 10)), target) if len(rows) else 0
    sent = spark.sparkContext.broadcast(centres)  # MOST_LISTS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(pa.chunked_array([batch.column("embedding")]))
            cosines = m @ sent.value.T / _norms(m)[:, None] if len(m) else np.zeros((0, 1))
            best = cosines.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_norms(m)), pa.array(cosines[np.arange(len(m)), best]), pa.array(best.astype(np.int32))], [*batch.schema.names, "norm", "near", "list"])

    placed = fit.mapInArrow(assign, "child_id long, parent_id long, embedding array<double>, norm double, near double, list int")
    tasks = max(1, -(-n * d * 8 // CHUNK_BYTES))
    placed.repartitionByRange(max(tasks, 1), "list", "child_id").sortWithinPartitions("list", "child_id").write.partitionBy("list").parquet(f"{path}/vectors")
    if not n:
        fit.select("*", F.lit(0.0).alias("norm"), F.lit(0.0).alias("near"), F.lit(0).alias("list")).write.mode("append").parquet(f"{path}/vectors")
    held = spark.read.parquet(f"{path}/vectors").groupBy("list").agg(F.count("*").alias("rows"), F.min("near").alias("reach"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    table.join(held, "list").coalesce(1).write.parquet(f"{path}/centres")
    spark.createDataFrame([(d, probes)], "dimensions int, probes int").coalesce(1).write.parquet(f"{path}/settings")
    return Index(path, d, probes)


def opened(spark: SparkSession, path: str) -> Index:
    """The index that ``build`` has stored."""
    r = spark.read.parquet(f"{path}/settings").first()
    return Index(path, r.dimensions, r.probes)


def _nearest_lists(index: Index, spark: SparkSession, vector: list[float]) -> list:
    """All lists, nearest first, with the highest score that a child of each can have; MOST_LISTS rows at most."""
    score = vectors.cosine(F.col("centre"), vectors.literal(vector))
    angle = F.greatest(F.acos(F.least(F.lit(1.0), score)) - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "reach"))), F.lit(0.0))
    return index.centres(spark).select("list", "rows", score.alias("score"), (F.cos(angle) + CLOSE).alias("most")).orderBy(F.desc("score"), "list").collect()


def nearest(spark: SparkSession, index: Index, vector: list[float], k: int, probes: int | None = None, exact: bool = False) -> tuple[DataFrame, int]:
    """((child_id, parent_id, score), rows read): the k best of the lists nearest to ``vector``; only these are scanned.

    ``exact``: the k-th score so far tells which other lists could hold a better child, by the angle between the vector
    and the list's centre and the widest angle within the list; those are read too, so nothing is missed. Filters of
    the caller follow the cut. A vector that is null, zero or of another length finds nothing."""
    order = [r for r in _nearest_lists(index, spark, vector) if r.score is not None]
    length = float(np.sqrt(np.sum(np.square(vector)))) if order else 0.0
    score = vectors.dot(F.col("embedding"), vectors.literal(vector)) / (F.col("norm") * F.lit(length))

    def of(lists: list) -> DataFrame:
        found = index.vectors(spark).filter(F.col("list").isin([r.list for r in lists])) if lists else index.vectors(spark).filter("false")
        return found.select("child_id", "parent_id", score.alias("score")).orderBy(F.desc("score"), "child_id").limit(k)

    read = order[: probes or index.probes]
    if exact:
        least = of(read).agg(F.min("score"), F.count("*")).first()
        read = [r for i, r in enumerate(order) if i < len(read) or least[1] < k or r.most >= least[0]]
    return of(read), sum(r.rows for r in read)


def nearest_many_indexed(spark: SparkSession, index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """The same as ``nearest_many``, approximately: each query meets the children of its nearest lists only.

    A list's children are dealt out in pieces by their number, so no task holds a whole popular list."""
    importable(spark)
    rows = index.centres(spark).orderBy("list").collect()  # MOST_LISTS at most
    per_piece = max(1, CHUNK_BYTES // (4 * max(1, index.dimensions)))
    sent = spark.sparkContext.broadcast((np.array([r.centre for r in rows]).reshape(len(rows), index.dimensions), np.array([r.list for r in rows], dtype=np.int32), np.array([-(-r.rows // per_piece) for r in rows])))
    want = probes or index.probes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, numbers, pieces = sent.value
        for batch in batches:
            m = _matrix(pa.chunked_array([batch.column("vector")]))
            if not len(m) or not len(numbers):
                continue
            near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :want]
            row = np.repeat(np.arange(len(m)), pieces[near].sum(axis=1))
            flat = np.repeat(near.reshape(-1), pieces[near].reshape(-1))
            ends = np.cumsum(pieces[near].reshape(-1))
            piece = np.arange(len(flat)) - np.repeat(ends - pieces[near].reshape(-1), pieces[near].reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(numbers[flat]), pa.array(piece.astype(np.int32))], [*batch.schema.names, "list", "piece"])

    q = _fit(queries, "vector", index.dimensions).select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(route, "query_id long, vector array<double>, list int, piece int")
    pieces = index.centres(spark).select("list", F.ceil(F.col("rows") / per_piece).cast("int").alias("pieces"))
    v = index.vectors(spark).join(F.broadcast(pieces), "list")
    c = v.select("child_id", "parent_id", "embedding", "list", F.pmod(F.xxhash64("child_id"), F.col("pieces")).cast("int").alias("piece"))
    return _meet(q, c, ["list", "piece"], k)
