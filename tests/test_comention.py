"""Neighbours of all parents against plain counting, wherever the line between light and heavy entities lies."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strataloom.operators import comention


def plain(rows, most):
    of, sets = defaultdict(set), defaultdict(set)
    for p, e in rows:
        if p is not None and e is not None:
            of[e].add(p)
            sets[p].add(e)
    out = set()
    for p, own in sets.items():
        others = {q for e in own for q in of[e]} - {p}
        ranked = sorted((-len(own & sets[q]), q) for q in others)[:most]
        out |= {(p, q, -n) for n, q in ranked}
    return out


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(2)
    rows = [(p, rnd.choice([rnd.randrange(3), rnd.randrange(20), rnd.randrange(200)])) for p in range(300) for _ in range(rnd.randrange(6))]
    return rows + rows[:50] + [(None, 1), (7, None), (999, 777)]


@pytest.mark.parametrize("heavy", [0, 5, 30, 10_000])
@pytest.mark.parametrize("sets", [1024, 20])
def test_all_neighbours(spark, table, monkeypatch, heavy, sets):
    monkeypatch.setattr(comention, "SETS", sets)
    got = comention.all_neighbours(spark.createDataFrame(table, "parent_id long, entity_id long"), 4, heavy)
    assert {tuple(r) for r in got.select("parent_id", "neighbour_id", "shared").collect()} == plain(table, 4)


def test_heavy_pairs_never_become_rows(spark):
    """One entity in all of 3,000 parents: nine million pairs, but few rows."""
    df = spark.range(3000).selectExpr("id AS parent_id", "1 AS entity_id")
    got = comention.all_neighbours(df, 5, 100)
    assert got.count() == 15_000 and {r.neighbour_id for r in got.collect()} == set(range(6))


def test_no_mentions(spark):
    assert comention.all_neighbours(spark.createDataFrame([], "parent_id long, entity_id long")).count() == 0


def through(rows, heavy, most, seeds=None):
    """The three passes in this process, over (parent_id, entity_id) in batches of seven rows."""
    numbered = {e: i for i, e in enumerate(sorted(heavy))}
    got = sorted(((p, None if e in numbered else e, numbered.get(e), seeds is None or p in seeds) for p, e in rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0, -1 if r[2] is None else r[2]))
    for names, types, step, key in (
        (["parent_id", "entity_id", "place", "seed"], [pa.int64(), pa.int64(), pa.int32(), pa.bool_()], comention._tell, lambda r: r[:2]),
        (["entity_id", "parent_id", "body"], [pa.int64(), pa.int64(), pa.binary()], comention._meet(len(numbered), most), lambda r: r[:1]),
        (["parent_id", "body"], [pa.int64(), pa.binary()], comention._choose(most), lambda r: r),
    ):
        batches = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got[i : i + 7]), types)], names) for i in range(0, len(got), 7))
        got = sorted((tuple(r.values()) for b in step(batches) for r in b.to_pylist()), key=key)
    return set(got)


def of_seeds(rows, most, seeds=None):
    return {r for r in plain(rows, most) if seeds is None or r[0] in seeds}


@pytest.mark.parametrize("wide", [0, 2, 64])
@pytest.mark.parametrize("rows_at_once", [1, 50, 100_000])
def test_passes(monkeypatch, wide, rows_at_once):
    """Light entities, with every pair that heavy ones alone make left to the other step."""
    monkeypatch.setattr(comention, "WIDE", wide)
    monkeypatch.setattr(comention, "ROWS", rows_at_once)
    monkeypatch.setattr(comention, "PAIRS", 11 if rows_at_once < 100 else 1_000_000)
    for case in range(12):
        rnd = random.Random(case)
        ids = rnd.choice([lambda: rnd.randrange(40), lambda: rnd.randrange(-(1 << 62), 1 << 62)])
        parents, entities = [ids() for _ in range(30)], [ids() for _ in range(rnd.choice([5, 15, 60]))]
        rows = [(p, rnd.choice(entities)) for p in parents for _ in range(rnd.randrange(8))]
        rows += rows[:20]
        seeds = set(parents[:10]) if case % 3 == 0 else None
        assert through(rows, [], 3, seeds) == of_seeds(rows, 3, seeds)
        heavy = entities[:2]
        # with one more entity that all share, no pair has heavy ones alone
        joint = rows + [(p, 1 << 61) for p in parents]
        assert through(joint, heavy, 3, seeds) == of_seeds(joint, 3, seeds)


def test_numbers_of_all_lengths():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 62, (1 << 63) - 1, 1 << 63, (1 << 64) - 1], dtype=np.uint64)
    counts = np.array([3, 0, 6, 1])
    column = comention.packed(values, counts)
    for a in (column, pa.concat_arrays([column, column]).slice(4, 4)):
        got, own = comention.unpacked(pa.chunked_array([a]))
        assert got.tolist() == values.tolist() and own.tolist() == counts.tolist()
    signed = np.array([0, -1, 1, -(1 << 63), (1 << 63) - 1])
    assert comention._unzigzag(comention._zigzag(signed)).tolist() == signed.tolist()


def test_light_pairs_never_become_rows():
    """One light entity in all of 3,000 parents, of which 300 pairs share another: a row for each parent and one for each of a pair."""
    rows = [(p, 1) for p in range(3000)] + [(p, 10 + (p // 2 if p < 600 else p)) for p in range(3000)]
    told = [b for b in comention._tell(iter([pa.record_batch([pa.array(c, t) for c, t in zip(zip(*((p, e, None, True) for p, e in sorted(rows))), (pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], ["parent_id", "entity_id", "place", "seed"])]))]
    met = pa.Table.from_batches(comention._meet(0, 5)(iter(pa.Table.from_batches(told).sort_by([("entity_id", "ascending"), ("parent_id", "ascending")]).to_batches())))
    assert met.num_rows == 3000 + 600 + 600  # the pairs' other entity tells its two parents too


def test_seeds(spark, table):
    asked = spark.createDataFrame([(p,) for p in (0, 7, 7, 250, None, 12345)], "parent_id long")
    for heavy in (5, 10_000):
        got = comention.all_neighbours(spark.createDataFrame(table, "parent_id long, entity_id long"), 4, heavy, asked)
        assert {tuple(r) for r in got.select("parent_id", "neighbour_id", "shared").collect()} == of_seeds(table, 4, (0, 7, 250))
