"""Operator 7, MinHash near-deduplication with sequential Bayesian verification.

1. Every document gets the sorted set of its word shingles' hashes, a hash of that set, and the hashes of its bands of
   MinHash values. Documents with the same set form a class; only its smallest doc_id goes on.
2. Documents that share a band's hash share a bucket; a pair of a bucket is a candidate.
3. First, each bucket's members are compared with its least document only, which is linear in their number and links
   all of a group of true copies. What that connects need not be compared again: of a bucket's other pairs only those
   remain that are not connected yet, and whose sets' sizes let them link at all. Those go to the tasks in blocks of
   bounded size: each task holds two blocks, so none holds a whole bucket, every pair meets in one task, and pairs
   never become rows. A pair counts in the first band that it shares.
4. There, candidates are compared by a second signature of 1024 values of 8 bits, batch after batch. After each
   batch a pair goes when the posterior probability that its similarity reaches the threshold has fallen below the
   chosen miss probability.
5. What survives is verified on the full sets of shingle hashes (64 bits), the most alike first; a pair that verified
   links of the same task connect already needs no further look. Links give components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm import shared
from strataloom.llm.components import connected_components

#: Most MinHash values for bands.
VALUES = 420
#: The chance that banding misses a pair right at the threshold; it falls steeply with the similarity.
BAND_MISS = 1e-6
LONG_VALUES = 1024
BATCH = 64
#: The chance that one comparison drops a pair at the threshold.
MISS = 1e-8
#: Members of a block, about, and bytes of its sets.
BLOCK = 256
BLOCK_BYTES = 8 << 20
#: Bytes of members that a task of comparisons gets, about.
TASK_BYTES = 32 << 20
#: So many candidates' ids go to all executors (some 32 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: So many rows of dealt members (some 16 MB) likewise.
BROADCAST_DEALT = 200_000
#: Documents by which buckets that hold a large share of all are found, and how many of them such a bucket has at least.
#: This decides how rows are dealt only: a bucket taken for small or large gives the same members.
SAMPLE, LARGE = 20_000, 8
#: A bucket's lowest bits are its band.
BAND_BITS = 10

#: Column with a row's number where doc_id doesn't tell rows apart.
_ROW = "__row"

_FACTORS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, (2, VALUES + LONG_VALUES), dtype=np.uint64).astype(np.uint32)
_FACTORS[1] |= np.uint32(1)


def bands(threshold: float) -> tuple[int, int]:
    """Number of bands and values a band: the longest bands, and no more of them than BAND_MISS asks for."""
    need = lambda r: math.ceil(math.log(BAND_MISS) / math.log1p(-min(threshold, 1 - 1e-9) ** r))
    r = max((r for r in range(1, VALUES + 1) if need(r) * r <= VALUES), default=1)
    return need(r), r


def minhash(sets: list[np.ndarray], first: int, count: int) -> np.ndarray:
    """A row of 32-bit MinHash values for each set; for an empty set all bits are 1."""
    out = np.full((len(sets), count), 0xFFFFFFFF, dtype=np.uint32)
    filled = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(filled):  # runs of sets that fit a processor's cache
        run, total = [], 0
        while at < len(filled) and (not run or total + len(sets[filled[at]]) <= 1 << 15):
            run.append(filled[at])
            total += len(sets[filled[at]])
            at += 1
        all_ = np.concatenate([sets[i] for i in run])
        low = (all_ ^ (all_ >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0] + [len(sets[i]) for i in run[:-1]])
        for k in range(count):
            x = (low ^ _FACTORS[0, first + k]) * _FACTORS[1, first + k]
            out[run, k] = np.minimum.reduceat(x ^ (x >> np.uint32(15)), starts)
    return out


@lru_cache(maxsize=16)
def least_matches(threshold: float) -> tuple[int, ...]:
    """For each batch, the fewest matches so far with which a pair stays.

    With a uniform prior, the posterior of the match rate p after m of n matches is Beta(m + 1, n - m + 1); a pair
    stays while P(p >= threshold's rate) >= MISS. Two different values of 8 bits agree once in 256.
    """
    rate = threshold + (1 - threshold) / 256
    grid = (np.arange(200_000) + 0.5) / 200_000
    logs, out = (np.log(grid), np.log1p(-grid)), []
    for n in range(BATCH, LONG_VALUES + 1, BATCH):
        low, high = 0, n
        while low < high:  # the probability grows with m
            m = (low + high) // 2
            density = m * logs[0] + (n - m) * logs[1]
            density = np.exp(density - density.max())
            if density[grid >= rate].sum() / density.sum() >= MISS:
                high = m
            else:
                low = m + 1
        out.append(low)
    return tuple(out)


def survivors(long_values: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (left[i], right[i]) of rows pass all batches, and their matches."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int32)
    for k, least in enumerate(least_matches(threshold)):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (long_values[left[alive], cols] == long_values[right[alive], cols]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive, matches


def band_keys(sets: list[np.ndarray], count: int, rows: int) -> np.ndarray:
    """A row of 64-bit numbers, one a band, for each set: a hash with the band's number."""
    sig = minhash(sets, 0, count * rows).reshape(len(sets), count, rows).astype(np.uint64)
    keys = np.zeros((len(sets), count), dtype=np.uint64)
    for k in range(rows):
        keys = shared.mix(keys + sig[:, :, k] + np.uint64(k + 1))
    return keys >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | np.arange(count, dtype=np.uint64)


def signatures(docs: DataFrame, width: int, count: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, keys): set_hash and keys are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for piece in shared.slices(batch, 1 << 20):
                sets = shared.shingle_sets(piece.column("text").to_pylist(), width)
                keys = band_keys(sets, count, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([row if len(s) else None for s, row in zip(sets, keys, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_hash", "keys"],
                )

    return shared.text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, keys array<long>")


def long_signatures(docs: DataFrame, width: int, count: int, rows: int) -> DataFrame:
    """(doc_id, n, keys, long, shingles): hashes of the bands, 1024 bytes of values, and the sorted set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch, 1 << 20):
                sets = shared.shingle_sets(piece.column("text").to_pylist(), width)
                values = minhash(sets, VALUES, LONG_VALUES).astype(np.uint8)
                cells = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), cells(band_keys(sets, count, rows)), cells(values), cells(sets)], ["doc_id", "n", "keys", "long", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, keys binary, long binary, shingles binary")


def links_in_block(ids, side, known, sizes, keys, band: int, long_values, sets, percent: int) -> list[tuple[int, int]]:
    """Verified links that connect what the candidates of one task connect; side tells its two blocks apart.

    known: members with the same number are connected already. band: below 0, a pair that shares any band is a
    candidate; else one whose first shared band it is.
    """
    order = np.argsort(sizes, kind="stable")
    ids, side, known, sizes, keys, long_values, sets = ids[order], side[order], known[order], sizes[order], keys[order], long_values[order], [sets[i] for i in order]
    two, lefts, rights = side.any(), [], []
    for i in range(len(ids) - 1):
        stop = np.searchsorted(sizes, sizes[i] * 100 // percent, side="right")  # beyond, sets are too large to link
        j = np.arange(i + 1, stop)
        j = j[known[j] != known[i]]
        if two:
            j = j[side[j] != side[i]]
        if len(j):
            same = keys[j] == keys[i]
            j = j[same.any(axis=1)] if band < 0 else j[same.any(axis=1) & (same.argmax(axis=1) == band)]
            lefts.append(np.full(len(j), i))
            rights.append(j)
    if not lefts:
        return []
    left, right = np.concatenate(lefts), np.concatenate(rights)
    keep, matches = survivors(long_values, left, right, percent / 100)
    best = keep[np.argsort(-matches, kind="stable")]
    root, links = np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]].tolist(), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(left[best].tolist(), right[best].tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[a] = b
                links.append((int(ids[i]), int(ids[j])))
    return links


_AT = ("group", "band", "one", "two")


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """The links of all tasks' blocks; rows come sorted by block inside partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def done():
            wide = lambda k, kind: np.frombuffer(b"".join([r[k] for r in held]), dtype=kind).reshape(len(held), -1)
            ids, side, known, sizes = (np.array([r[k] for r in held], dtype=np.int64) for k in range(4))
            found = links_in_block(ids, side, known, sizes, wide(4, "<u8"), at[1], wide(5, np.uint8), [np.frombuffer(r[6], dtype=np.uint64) for r in held], percent)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (*_AT, "doc_id", "side", "known", "n", "keys", "long", "shingles")]
            for group, band, one, two, *row in zip(*cols, strict=True):
                if (group, band, one, two) != at:
                    if len(held) > 1:
                        yield done()
                    held, at = [], (group, band, one, two)
                held.append(tuple(row))
        if len(held) > 1:
            yield done()

    return rows.mapInArrow(run, "a long, b long")


def _class_width(percent: int) -> float:
    """Logarithm of how much larger the sets of the next class are: a little more than a link allows."""
    return math.log(100 / min(percent, 99)) * 1.001


def _class(percent: int) -> Column:
    """Sets whose sizes are more than one class apart can't link."""
    return F.floor(F.log(F.col("n").cast("double")) / _class_width(percent)).cast("int")


def _blocks(percent: int) -> Column:
    """Blocks of a cell of ``members`` members of one class."""
    largest = F.exp((F.col("class") + 1) * _class_width(percent))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * largest))))
    return F.ceil(F.col("members") / most).cast("int")


def _stars(members: DataFrame, percent: int, t: shared.Tables) -> DataFrame:
    """Every member of a bucket against its least document: one row for each of the two in a task's block."""
    pairs = t.store(members.filter("doc_id <> least").select("least", "doc_id", _class(percent).alias("class")).distinct(), "stars")
    cells = pairs.groupBy("least", "class").agg(F.count("*").alias("members")).withColumn("blocks", _blocks(percent))
    own = shared.with_key_row(pairs, cells, ["least", "class"], pairs.count()).withColumn("two", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    shape = lambda df, doc, side: df.select(F.col("least").alias("group"), F.lit(-1).alias("band"), F.col("class").cast("long").alias("one"), "two", F.col(doc).alias("doc_id"), F.lit(side).alias("side"), F.col(doc).alias("known"))
    heads = cells.withColumn("two", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    return shape(own, "doc_id", 1).unionByName(shape(heads, "least", 0))


def _remaining(members: DataFrame, found: DataFrame, percent: int, total: int, t: shared.Tables) -> DataFrame | None:
    """The members of buckets with pairs that the stars neither connected nor compared, once for each block they meet.

    A bucket's core is what is connected with its least document. Pairs inside the core are done; each other member
    meets the others and the core, by blocks, in its own and the neighbouring classes of size. Of buckets with the same
    members one goes on, where all pairs count; in any other a pair counts if this is its first band. None if nothing is left.
    """
    of = lambda name, column: found.select(F.col("node").alias(name), F.col("component").alias(column))
    m = members.filter("doc_id <> least").join(of("doc_id", "own_component"), "doc_id", "left").join(of("least", "least_component"), "least", "left")
    m = m.withColumns({"known": F.coalesce("own_component", "doc_id"), "of_least": F.coalesce("least_component", "least"), "class": _class(percent)})
    m = t.store(m.select("bucket", "doc_id", "known", "class", (F.col("known") == F.col("of_least")).cast("int").alias("core")), "remaining")
    mark = lambda k: F.bit_xor(F.xxhash64("doc_id", F.lit(k)))
    cells = m.groupBy("bucket", "core", "class").agg(F.count("*").alias("members"), mark(1).alias("x"), mark(2).alias("y")).withColumn("blocks", _blocks(percent))
    # cells of a bucket are as many as classes of size: some hundred at most
    buckets = cells.groupBy("bucket").agg(F.collect_list(F.struct("core", "class", "blocks")).alias("cells"), F.sum("members").alias("members"), F.sum(F.when(F.col("core") == 0, F.col("members")).otherwise(0)).alias("others"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    buckets = t.store(buckets.filter("others > 0 and members > 1"), "buckets")
    if buckets.isEmpty():
        return None
    same = buckets.groupBy("x", "y", "members").agg(F.min("bucket").alias("bucket"), F.count("*").alias("alike")).select("bucket", "alike")
    buckets = t.store(buckets.join(same, "bucket").select("bucket", "cells", "members", "alike"), "distinct-buckets")
    a = shared.with_key_row(m, buckets, ["bucket"], total)
    near = F.filter("cells", lambda c: (F.abs(c["class"] - F.col("class")) <= 1) & (c["core"] + F.col("core") < 2))
    own = F.filter("cells", lambda c: (c["class"] == F.col("class")) & (c["core"] == F.col("core")))[0]["blocks"]
    code = lambda core, class_, block: (core * 4096 + class_).cast("long") * F.lit(1 << 32) + block
    a = a.withColumn("me", code(F.col("core"), F.col("class"), F.pmod(F.xxhash64("doc_id"), own)))
    meets = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda k: code(c["core"], c["class"], k))))
    band = F.when(F.col("alike") > 1, -1).otherwise(F.col("bucket").bitwiseAND((1 << BAND_BITS) - 1).cast("int"))
    a = a.select(band.alias("band"), F.col("bucket").alias("group"), "doc_id", "known", "me", F.explode(meets).alias("other"))
    return a.select("group", "band", F.least("me", "other").alias("one"), F.greatest("me", "other").alias("two"), "doc_id", (F.col("me") > F.col("other")).cast("int").alias("side"), "known")


def _compared(dealt: DataFrame, long_: DataFrame, mean_bytes: float, percent: int, t: shared.Tables) -> DataFrame:
    """(a, b): the links of dealt members."""
    dealt = t.store(dealt, "dealt")
    n = dealt.count()
    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * mean_bytes / TASK_BYTES))
    dealt = F.broadcast(dealt) if n <= BROADCAST_DEALT else dealt
    return t.store(_links(long_.join(dealt, "doc_id").repartition(parts, *_AT).sortWithinPartitions(*_AT), percent), "links")


def _members(classes: DataFrame, n: int, t: shared.Tables) -> DataFrame:
    """(bucket, doc_id, n, members, least) of all buckets of two or more; n is the size of the document's set.

    Buckets that a sample shows to be large get their count and least document by an aggregation that combines before
    the shuffle, and a broadcast; all others by a window over their few rows, in one shuffle.
    """
    banded = classes.select(F.col("rep").alias("doc_id"), F.explode("keys").alias("bucket"))
    some = classes.filter(F.pmod(F.xxhash64("set_hash"), F.lit(max(1, n // SAMPLE))) == 0).select(F.explode("keys").alias("bucket"))
    large = some.groupBy("bucket").count().filter(F.col("count") >= LARGE).select("bucket")
    # SAMPLE * bands / LARGE numbers at most
    hot = banded.join(F.broadcast(large), "bucket", "left_semi")
    sums = hot.groupBy("bucket").agg(F.count("*").alias("members"), F.min("doc_id").alias("least"))
    cold = banded.join(F.broadcast(large), "bucket", "left_anti")
    whole = Window.partitionBy("bucket")
    cold = cold.withColumns({"members": F.count("*").over(whole), "least": F.min("doc_id").over(whole)}).filter("members > 1")
    found = cold.unionByName(hot.join(F.broadcast(sums.filter("members > 1")), "bucket"))
    sizes = classes.select(F.col("rep").alias("doc_id"), "n")
    return t.store(found.join(sizes, "doc_id"), "members")


def _joined(found: DataFrame, links: DataFrame, t: shared.Tables) -> DataFrame:
    """(node, component) of the first links and these together: further links connect the components found so far."""
    known = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component"))
    ends = links.join(known("a"), "a", "left").join(known("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    wider = t.store(connected_components(ends, tables=t), "wider")
    own = wider.select(F.col("node").alias("component"), F.col("component").alias("wider"))
    moved = found.join(own, "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    return moved.unionByName(wider.join(found.select("node"), "node", "left_anti"))


def _components(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, n_shingles, component) of every row of (doc_id, text), stored; here doc_id is any unique number."""
    count, rows = bands(percent / 100)
    with shared.Tables() as t:
        base = t.store(signatures(docs, width, count, rows), "signatures")
        # classes of equal sets: one row each goes on
        classes = t.store(base.filter("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("keys").alias("keys")), "classes")
        n = classes.count()
        total = n * count
        members = _members(classes, n, t)
        ids = t.store(members.select("doc_id").distinct(), "candidates")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        long_ = t.store(long_signatures(docs.join(ids, "doc_id"), width, count, rows), "long-signatures")
        mean_bytes = LONG_VALUES + 8 * count + 8 * (long_.agg(F.avg("n")).first()[0] or 0)
        first = _compared(_stars(members, percent, t), long_, mean_bytes, percent, t)
        found = connected_components(first, tables=t)
        rest = _remaining(members, found, percent, total, t)
        if rest is not None:
            found = _joined(found, _compared(rest, long_, mean_bytes, percent, t), t)
        # members of a class share its component
        reps = classes.select("set_hash", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(F.col("set_hash").alias("own_set"), F.coalesce("component", "rep").alias("component"))
        out = base.select("doc_id", "n_shingles", "set_hash").join(reps, F.col("set_hash") == F.col("own_set"), "left")
        return t.result(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")), "components")


def _has_own_ids(docs: DataFrame) -> bool:
    """Whether doc_id tells all rows apart and none is null."""
    return docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().filter("count > 1 or doc_id is null").isEmpty()


def _judged(keyed: DataFrame, percent: int, width: int) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, kept) of rows with a number each; of equal rows with a doc_id only one."""
    with shared.Tables() as t:
        rows = shared.text_of(keyed.withColumn("doc_id", F.col("doc_id").cast("long")), _ROW, "doc_id")
        # of a doc_id's equal texts one row goes on; rows without doc_id are each their own
        own = F.when(F.col("doc_id").isNull(), F.col(_ROW))
        first = rows.groupBy("doc_id", F.sha2("text", 256).alias("text_hash"), own.alias("own")).agg(F.min(_ROW).alias(_ROW))
        first = t.store(first.select(_ROW, "doc_id", "text_hash"), "first-rows")
        found = _components(rows.join(first.select(_ROW), _ROW, "left_semi").select(F.col(_ROW).alias("doc_id"), "text"), percent, width)
        found = t.store(found.withColumnRenamed("doc_id", _ROW).join(first, _ROW), "judged")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", _ROW)).alias("least")
        best = found.groupBy("component").agg(least, F.count("*").alias("members")).select("component", "members", F.col("least.doc_id").alias("component_id"), F.col(f"least.{_ROW}").alias("best"))
        out = shared.with_key_row(found, best, ["component"], found.count())
        return t.result(out.select(_ROW, "doc_id", "n_shingles", "component_id", (F.col(_ROW) == F.col("best")).alias("kept")), "judged-rows")


def _numbered(docs: DataFrame, t: shared.Tables) -> DataFrame:
    """docs, stored with a number of each row, for where doc_id doesn't tell them apart."""
    return t.store(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")


def groups(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Words are runs without white space, A-Z lower-cased; the set has the distinct shingles of ``width`` words, or
    the whole sequence where there are fewer. Documents link where 100 * intersection >= percent * union. A text
    without words, or null, has an empty set and links with nothing. component_id is the least doc_id of a group,
    null where none has one; one document of each group is kept, of the least doc_id. Rows that repeat a doc_id with
    other texts are documents of their own, linked by their texts (so groups may share a component_id); rows that
    repeat both are one document, with one row here. Rows without doc_id link by their texts, and any doc_id comes
    before none. An empty table gives no rows. Extra columns are ignored.
    """
    if not _has_own_ids(docs):
        with shared.Tables() as t:
            return _judged(_numbered(docs.select("doc_id", "text"), t), percent, width).drop(_ROW)
    found = _components(shared.text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id"), percent, width)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """Exactly one row of each group, that of the least doc_id; all columns stay as they are.

    Of rows that share a doc_id, those with texts of different groups each stay, and of equal rows one. Texts without
    words, null ones among them, stay. A column may have any name. An empty table stays empty."""
    if not _has_own_ids(docs):
        aside = next(n for k in range(len(docs.columns) + 1) if (n := f"{_ROW}{k}") not in docs.columns)  # a name that is free
        with shared.Tables() as t:
            keyed = _numbered(docs.withColumnRenamed(_ROW, aside), t)
            kept = keyed.join(_judged(keyed, percent, width).filter("kept").select(_ROW), _ROW, "left_semi").drop(_ROW)
            return t.result(kept.withColumnRenamed(aside, _ROW), "kept-rows")
    gone = groups(docs, percent, width).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def oracle_sql(percent: int = 85, width: int = 5) -> str:
    """DuckDB SQL for ``groups`` over the view ``documents`` with doc_ids of its own: all pairs that share a shingle."""
    grams = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, width))])
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words FROM documents),
tokens AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d WHERE len(words) >= {width}),
long_ AS (SELECT doc_id, {grams} AS s FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(s) AS s FROM long_ WHERE s IS NOT NULL
  UNION ALL SELECT doc_id, md5_number(array_to_string(words, ' ')) FROM d WHERE len(words) BETWEEN 1 AND {width - 1}),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a, a AS least FROM ways UNION SELECT ways.b, reach.least FROM reach JOIN ways ON ways.a = reach.a WHERE reach.least < ways.b),
components AS (SELECT a AS doc_id, min(least) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, d.doc_id) AS component_id, coalesce(least, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN components USING (doc_id)
"""
