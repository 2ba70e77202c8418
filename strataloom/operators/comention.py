"""For all parents, the parents that share most entities with each, where some entities are in very many parents.

An entity that n parents mention makes n * n pairs. Hardly any of them matter, so they never become rows:

* Entities of very many mentions, heavy ones: each parent has a set of them; parents with equal sets are alike in them, so
  only distinct sets are compared, in blocks, by products of 0/1 matrices, and each set keeps its few best parents.
* Of the other, light ones, each parent tells an entity which further light entities it has. There the parents that share
  two or more are found and told each other. Of those that share that entity only, the first few by id can be among a parent's
  best, and, if the parent has heavy entities, the few that share most of these with it.

Both steps pass over sorted rows in Arrow batches. Ids travel as differences of few bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom import importable, storage

MOST_NEIGHBOURS = 5
#: An entity of more mentions is heavy, at least; and the most heavy entities, which the limit grows for.
HEAVY = 1000
MOST_HEAVY = 4096
#: Counters that tell which entities can be heavy: one counts an eighth of the limit on average, at most.
COUNTERS = 8 * MOST_HEAVY
#: Distinct sets of a group that meets another one in a task.
SETS = 1024
#: A parent of more light entities tells them one by one, since what it tells grows with their number's square; its pairs are rows.
WIDE = 64
#: Rows and bytes that a task handles at once, unless one key has more, and pairs.
ROWS = 100_000
BYTES = 8 << 20
PAIRS = 1_000_000

_BEST = "set_id long, overlap int, neighbour_id long"
#: body: whether the parent is wide and whether it gets neighbours, places of its heavy entities, its further light entities.
_TOLD = "entity_id long, parent_id long, body binary"
#: body: light, heavy, ids of neighbours in order. light: times that an entity and a further one are shared; below 0 entities
#: counted one by one; 0: one at least, not counted. heavy: heavy entities shared, as far as looked at.
_MET = "parent_id long, body binary"
_FOUND = "parent_id long, neighbour_id long, shared long"


def _best_sets(sets: DataFrame, width: int, keep: int) -> DataFrame:
    """(set_id, overlap, neighbour_id): of each set the ``keep`` parents whose sets share most with it, ties by id."""
    groups = max(1, -(-sets.count() // SETS))
    spread = lambda own, other: sets.withColumn(own, F.pmod(F.xxhash64("set_id"), F.lit(groups))).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias(other))

    def matrix(t: pa.Table) -> np.ndarray:
        out = np.zeros((t.num_rows, width), dtype=np.float32)
        for i, members in enumerate(t.column("members").to_pylist()):
            out[i, members] = 1
        return out

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        rows: list[list[int]] = [[], [], []]
        if a.num_rows and b.num_rows:
            firsts = b.column("firsts").to_pylist()
            ids = np.array([i for own in firsts for i in own])
            at = np.repeat(np.arange(len(firsts)), [len(own) for own in firsts])
            shared = (matrix(a) @ matrix(b).T).astype(np.int64)[:, at]
            for set_id, own in zip(a.column("set_id").to_pylist(), shared, strict=True):
                some = np.flatnonzero(own)
                order = some[np.lexsort((ids[some], -own[some]))][:keep]
                for column, values in zip(rows, ([set_id] * len(order), own[order].tolist(), ids[order].tolist()), strict=True):
                    column.extend(values)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("set_id", "overlap", "neighbour_id"), rows, (pa.int64(), pa.int32(), pa.int64()), strict=True)})

    met = spread("one", "two").groupBy("one", "two").cogroup(spread("two", "one").groupBy("one", "two")).applyInArrow(meet, _BEST)
    order = Window.partitionBy("set_id").orderBy(F.desc("overlap"), "neighbour_id")
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).drop("place")


# whole numbers in few bytes, and rows of a key


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values, each of so many of the unsigned numbers in turn: seven bits a byte, the eighth where more follow."""
    size = np.searchsorted(np.uint64(1) << np.arange(7, 64, 7, dtype=np.uint64), values, side="right") + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(ends[-1], dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[ends[some] + k] = (values[some] >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    offsets = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many of them each value holds)."""
    a = column.combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int32, count=len(a) + a.offset + 1)[a.offset :]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    values = np.zeros(len(ends), dtype=np.uint64)
    size = ends - begins + 1
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        values[some] |= (data[begins[some] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return values, np.diff(np.searchsorted(ends, offsets - offsets[0]))


def _zigzag(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def _unzigzag(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches as tables in which all rows of a key are together."""
    held, n, most, size, most_bytes = [], 0, ROWS, 0, BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n < most and size < most_bytes:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        keys = t.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), n - cut
        size = sum(b.nbytes for b in held)
        most, most_bytes = max(ROWS, 2 * n), max(BYTES, 2 * size)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where another key begins."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ..., so many of each."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - counts), counts)


def _blocks(counts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, number) of all of so many items each, ``most`` at a time."""
    ends = np.cumsum(counts)
    for a in range(0, int(ends[-1]) if len(ends) else 0, most):
        at = np.arange(a, min(a + most, int(ends[-1])))
        which = np.searchsorted(ends, at, side="right")
        yield which, at - (ends - counts)[which]


def _joined(*parts: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """``packed`` values of several parts, each (numbers, how many of them each value gets)."""
    counts = np.sum([c for _, c in parts], axis=0, dtype=np.int64)
    out, at = np.empty(int(counts.sum()), dtype=np.uint64), np.cumsum(counts) - counts
    for values, own in parts:
        out[_ranges(at, own)] = values
        at = at + own
    return packed(out, counts)


def _firsts(begins: np.ndarray, n: int, most: int) -> np.ndarray:
    """The places of the first few rows of each run."""
    return _ranges(begins, np.minimum(np.diff(np.append(begins, n)), most))


# what parents tell entities, entities parents, and what parents make of it


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (parent_id, entity_id, place, seed) by parent and entity, null first, as _TOLD: of each light entity of a parent
    the light ones that follow it and the places of all heavy ones."""
    for t in _whole(batches, "parent_id"):
        parents, seeds = t.column("parent_id").to_numpy(), t.column("seed").to_numpy()
        entities, places = t.column("entity_id").fill_null(0).to_numpy(), t.column("place").fill_null(-1).to_numpy()
        once = _begins(parents, entities, places)
        parents, seeds, entities, places = parents[once], seeds[once], entities[once], places[once]
        light = places < 0
        begins = _begins(parents)
        counts = np.diff(np.append(begins, len(parents)))
        marks = np.add.reduceat(~light, begins, dtype=np.int64)
        owner = np.repeat(np.arange(len(begins)), counts)[light]
        ends = np.repeat(begins + counts, counts)[light]
        at = np.flatnonzero(light)
        wide = (counts - marks)[owner] > WIDE
        rest = np.where(wide, 0, ends - at - 1)
        # some rows at a time, since each has places and entities of its own
        cuts = np.flatnonzero(np.diff(np.cumsum(1 + rest + marks[owner]) // PAIRS, prepend=0))
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            mine, of = at[a:b], owner[a:b]
            follow, own = _ranges(mine + 1, rest[a:b]), _ranges(begins[of], marks[of])
            one = np.ones(len(mine), dtype=np.int64)
            head = (marks[of] << 2 | wide[a:b] << 1 | seeds[mine]).astype(np.uint64)
            body = _joined((head, one), (places[own].astype(np.uint64), marks[of]), ((entities[follow] - entities[follow - 1]).view(np.uint64), rest[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(entities[mine]), pa.array(parents[mine]), body], ["entity_id", "parent_id", "body"])


def _made(parents: np.ndarray, ids: np.ndarray, counts: np.ndarray, light: np.ndarray, heavy: np.ndarray) -> pa.RecordBatch:
    """Rows of _MET. ids ascend within a row: the first as its difference from the parent, the others from the one before."""
    begins, one = np.cumsum(counts) - counts, np.ones(len(parents), dtype=np.int64)
    differences = np.diff(ids, prepend=0).view(np.uint64)
    differences[begins] = _zigzag(ids[begins] - parents)
    return pa.RecordBatch.from_arrays([pa.array(parents), _joined((_zigzag(light), one), (heavy.view(np.uint64), one), (differences, counts))], ["parent_id", "body"])


def _meet(width: int, most: int):
    """Rows of _TOLD by entity and parent, as _MET."""
    step = max(1, min(PAIRS, (PAIRS << 5) // max(1, -(-width // 8))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, "entity_id"):
            entities, parents = t.column("entity_id").to_numpy(), t.column("parent_id").to_numpy()
            n = len(parents)
            numbers, size = unpacked(t.column("body"))
            at = np.cumsum(size) - size
            head = numbers[at].view(np.int64)
            marks, wide, seeds = head >> 2, (head & 2) > 0, (head & 1) > 0
            places, rest = numbers[_ranges(at + 1, marks)].astype(np.int64), size - 1 - marks
            further = numbers[_ranges(at + 1 + marks, rest)].view(np.int64)
            begins = _begins(entities)
            counts = np.diff(np.append(begins, n))
            group = np.repeat(np.arange(len(begins)), counts)
            bits = np.zeros((n if len(places) else 0, -(-width // 8)), dtype=np.uint8)
            if len(places):
                np.bitwise_or.at(bits, (np.repeat(np.arange(n), marks), places >> 3), (1 << (places & 7)).astype(np.uint8))

            def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                out, both = np.zeros(len(a), dtype=np.int64), np.flatnonzero((marks[a] > 0) & (marks[b] > 0))
                out[both] = np.bitwise_count(bits[a[both]] & bits[b[both]]).sum(axis=1, dtype=np.int64)
                return out

            def told(a: np.ndarray, b: np.ndarray, light: np.ndarray) -> pa.RecordBatch:
                return _made(parents[a], parents[b], np.ones(len(a), dtype=np.int64), light, overlap(a, b))

            # the first few by id but the parent itself
            own = np.flatnonzero(seeds & (counts[group] > 1))
            near = begins[group[own], None] + np.arange(most + 1)
            there = (near < (begins + counts)[group[own], None]) & (near != own[:, None])
            there &= np.cumsum(there, axis=1) <= most
            if len(own):
                yield _made(parents[own], parents[near[there]], there.sum(axis=1), np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64))

            # those that share a further entity
            row = np.repeat(np.arange(n), rest)
            total = np.cumsum(further)
            ahead = np.cumsum(rest) - rest
            further = entities[row] + total - np.concatenate([[0], total])[ahead[row]]
            some = counts[group[row]] > 1
            row, further = row[some], further[some]
            order = np.lexsort((further, group[row]))  # rows of a run stay in order
            row, further = row[order], further[order]
            runs = _begins(group[row], further) if len(row) else np.empty(0, dtype=np.int64)
            size = np.diff(np.append(runs, len(row)))
            runs, size = runs[size > 1], size[size > 1]
            for which, number in _blocks(size * size, PAIRS):
                a, b = row[runs[which] + number // size[which]], row[runs[which] + number % size[which]]
                some = (a != b) & seeds[a]
                pairs, times = np.unique(a[some] * n + b[some], return_counts=True)
                for c in range(0, len(pairs), step):
                    yield told(pairs[c : c + step] // n, pairs[c : c + step] % n, times[c : c + step].astype(np.int64))

            # pairs of which one tells its entities one by one
            if wide.any():
                wides = np.flatnonzero(wide)
                held = np.bincount(group[wides], minlength=len(begins))
                ahead = np.cumsum(held) - held
                number_of = np.where(wide, counts[group], held[group]) * seeds
                for which, number in _blocks(number_of, step):
                    b = np.where(wide[which], begins[group[which]] + number, wides[np.minimum(ahead[group[which]] + number, len(wides) - 1)])
                    some = which != b
                    yield told(which[some], b[some], np.full(int(some.sum()), -1, dtype=np.int64))

            # those that share most heavy entities with the parent
            marked = np.flatnonzero(marks > 0)
            held = np.bincount(group[marked], minlength=len(begins))
            ahead = np.cumsum(held) - held
            own = marked[seeds[marked]]
            for which, number in _blocks(np.where(held[group[own]] > 1, held[group[own]], 0), step):
                a, b = own[which], marked[ahead[group[own[which]]] + number]
                shared = overlap(a, b)
                some = (a != b) & (shared > 0)
                a, b, shared = a[some], b[some], shared[some]
                order = np.lexsort((b, -shared, a))
                order = order[_firsts(_begins(a[order]), len(order), most)] if len(order) else order
                yield _made(parents[a[order]], parents[b[order]], np.ones(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64), shared[order])

    return meet


def _choose(most: int):
    """Rows of _MET by parent, as _FOUND: the ``most`` that share most, ties by id."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, "parent_id"):
            owners = t.column("parent_id").to_numpy()
            numbers, size = unpacked(t.column("body"))
            at, counts = np.cumsum(size) - size, size - 2
            ids, firsts = numbers[_ranges(at + 2, counts)].view(np.int64), np.cumsum(counts) - counts
            ids[firsts] = _unzigzag(ids[firsts].view(np.uint64)) + owners
            total = np.cumsum(ids)  # wraps, as the differences of it do
            ids = total - np.repeat(np.concatenate([[0], total])[firsts], counts)
            row = np.repeat(np.arange(len(owners)), counts)
            begins = _begins(owners)
            owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(owners))))[row]
            light, heavy = _unzigzag(numbers[at])[row], numbers[at + 1].view(np.int64)[row]
            order = np.lexsort((ids, owner))
            owner, ids, light, heavy = owner[order], ids[order], light[order], heavy[order]
            at = _begins(owner, ids)
            one_by_one, times = -np.add.reduceat(np.minimum(light, 0), at), np.add.reduceat(np.maximum(light, 0), at)
            # c entities in common are met c * (c - 1) / 2 times with a further one
            shared = np.where(one_by_one > 0, one_by_one, np.rint((1 + np.sqrt(1 + 8.0 * times)) / 2).astype(np.int64)) + np.maximum.reduceat(heavy, at)
            owner, ids = owner[at], ids[at]
            order = np.lexsort((ids, -shared, owner))
            order = order[_firsts(_begins(owner[order]), len(order), most)]
            yield pa.RecordBatch.from_arrays([pa.array(owners[begins][owner[order]]), pa.array(ids[order]), pa.array(shared[order])], ["parent_id", "neighbour_id", "shared"])

    return choose


def _tell_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (parent_id, neighbour_id, overlap) as _MET: as if a light entity, which counts one, were shared in place of a heavy one."""
    for b in batches:
        parents, none = b.column("parent_id").to_numpy(), np.zeros(b.num_rows, dtype=np.int64)
        yield _made(parents, b.column("neighbour_id").to_numpy(), none + 1, none, b.column("overlap").to_numpy().astype(np.int64) - 1)


def all_neighbours(mentions: DataFrame, most: int = MOST_NEIGHBOURS, heavy: int = HEAVY, seeds: DataFrame | None = None) -> DataFrame:
    """(parent_id, neighbour_id, shared): for every parent of mentions (parent_id, entity_id; whole numbers) the ``most``
    parents that share most entities with it, ties by id; as ``retrieval.neighbours`` with all parents as seeds.

    Repeated mentions count once, rows with a null are left out, a parent without shared entities has no rows. Distinct
    heavy sets meet all others; there are as many as parents at the worst, in pairs of blocks and never as rows. Tables
    that later steps read are stored in the shared folder. ``seeds`` (parent_id): only these parents get neighbours, and
    only their entities are looked at; mentions are read several times."""
    spark = mentions.sparkSession
    importable(spark)
    at = storage.shared_folder(spark, "comention")
    m = mentions.select(F.col("parent_id").cast("long").alias("parent_id"), F.col("entity_id").cast("long").alias("entity_id")).dropna()
    if seeds is None:
        m = m.withColumn("seed", F.lit(True))
    else:
        chosen = storage.stored(seeds.select(F.col("parent_id").cast("long").alias("parent_id")).dropna().distinct(), f"{at}/seeds")
        m = m.join(m.join(chosen, "parent_id", "left_semi").select("entity_id").distinct(), "entity_id", "left_semi")
        m = storage.stored(m.join(chosen.withColumn("seed", F.lit(True)), "parent_id", "left").select("parent_id", "entity_id", F.coalesce("seed", F.lit(False)).alias("seed")), f"{at}/mentions")
    # an entity of more mentions than the limit makes its counter exceed it, so only such counters' entities are counted
    counter = F.pmod(F.xxhash64("entity_id"), F.lit(COUNTERS)).alias("counter")
    counted = storage.stored(m.groupBy(counter).agg(F.count("*").alias("n")), f"{at}/counters")
    limit = max(heavy, (counted.agg(F.sum("n")).first()[0] or 0) // MOST_HEAVY)
    maybe = m.select("parent_id", "entity_id", counter).join(F.broadcast(counted.filter(F.col("n") > limit)), "counter", "left_semi")
    popular = maybe.groupBy("entity_id").agg(F.count_distinct("parent_id").alias("n")).filter(F.col("n") > limit)
    # MOST_HEAVY rows at most, so one window numbers them, and they are broadcast
    numbered = storage.stored(popular.select("entity_id", (F.row_number().over(Window.orderBy("entity_id")) - 1).alias("place")), f"{at}/heavy")
    width = numbered.count()
    placed = m.join(F.broadcast(numbered), "entity_id", "left").select("parent_id", F.when(F.col("place").isNull(), F.col("entity_id")).alias("entity_id"), "place", "seed")
    told = placed.repartition("parent_id").sortWithinPartitions("parent_id", "entity_id", "place").mapInArrow(_tell, _TOLD)
    met = told.repartition("entity_id").sortWithinPartitions("entity_id", "parent_id").mapInArrow(_meet(width, most), _MET)
    if width:
        held = m.join(F.broadcast(numbered), "entity_id").groupBy("parent_id").agg(F.sort_array(F.collect_set("place")).alias("members"), F.first("seed").alias("seed"))
        held = storage.stored(held.withColumn("set_id", F.xxhash64(F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))))), f"{at}/sets-of-parents")
        first = Window.partitionBy("members", "set_id").orderBy("parent_id")
        few = held.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most + 1)
        sets = storage.stored(few.groupBy("set_id", "members").agg(F.sort_array(F.collect_list("parent_id")).alias("firsts")), f"{at}/sets")
        best = storage.stored(_best_sets(sets, width, most + 1), f"{at}/best-of-sets")
        by_heavy = held.filter("seed").select("parent_id", "set_id").join(best, "set_id").filter("neighbour_id <> parent_id")
        met = met.unionByName(by_heavy.select("parent_id", "neighbour_id", "overlap").mapInArrow(_tell_heavy, _MET))
    return met.repartition("parent_id").sortWithinPartitions("parent_id").mapInArrow(_choose(most), _FOUND)
