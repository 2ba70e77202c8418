"""No span of time exceeds a limit, whatever the partitions."""

import random

import pytest

from strataloom.operators import admission


@pytest.mark.parametrize(("requests", "tokens", "most"), [(5, 1000, 300), (3, 100, 150), (50, 200, 10), (1, 10, 5)])
def test_no_span_exceeds_a_limit(spark, requests, tokens, most):
    rnd = random.Random(requests)
    rows = [(i, rnd.randrange(50), rnd.choice([None, 0, rnd.randrange(1, most + 1)])) for i in range(400)]
    df = spark.createDataFrame(rows, "call_id long, seq long, tokens long")
    got = {r.call_id: r.start_ms for r in admission.plan(df.repartition(7), requests, tokens, 1000).collect()}
    assert got == {r.call_id: r.start_ms for r in admission.plan(df.coalesce(1), requests, tokens, 1000).collect()} and len(got) == 400
    need = {i: min(max(t or 1, 1), tokens) for i, _, t in rows}
    starts = sorted((s, need[i]) for i, s in got.items())
    for k, (s, _) in enumerate(starts):
        inside = [n for t, n in starts[k:] if t < s + 1000]
        assert len(inside) <= requests and sum(inside) <= tokens
    # in order, but for calls of over half a window
    order = [i for i, q, _ in sorted(rows, key=lambda r: (r[1], r[0])) if max(need[i] * requests, tokens) * 2 <= requests * tokens]
    assert [got[i] for i in order] == sorted(got[i] for i in order)


def test_few_windows(spark):
    df = spark.range(1000).selectExpr("id AS call_id", "id AS seq", "10 AS tokens")
    assert admission.plan(df, 100, 1000).agg({"window": "max"}).first()[0] <= 11
    assert admission.plan(df.limit(0), 100, 1000).count() == 0
    with pytest.raises(ValueError):
        admission.plan(df, 0, 1)
