"""Summaries of slices of a log: any split gives the same rows, merging is associative, statuses are mapped as stepping does."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import read_model as R
from strataloom.operators import snapshots
from strataloom.storage import shared_folder

KINDS = [R.ATTACHED, R.STORED, R.PROGRESS, R.PARSED, R.CHUNKED, R.EXTRACTED, R.INDEXED, R.FAILED, "Unknown"]
SCHEMA = "aggregate_id string, event_type string, event_version int, " + ", ".join(f"{k} {t}" for k, t in R.PAYLOAD.items())


def events_of(rnd, doc, n):
    out = []
    for v in range(1, n + 1):
        kind = rnd.choices([*KINDS, R.DELETED], [1, 3, 6, 3, 1, 1, 1, 3, 1, 0.1])[0]
        e = dict.fromkeys(R.PAYLOAD) | {"aggregate_id": doc, "event_type": kind, "event_version": v}
        e |= {"file_name": f"f{v}", "storage_path": rnd.choice([None, f"p{v}"]), "enable_ocr": rnd.random() < 0.5, "ocr_instructions": None, "step": rnd.choice(["OCR", "CHUNKING", "INDEXED"]), "error_message": f"e{v}"}
        e |= {"current": v, "total": 9, "percentage": rnd.randrange(101), "message": f"m{v}", "total_parents": v, "total_children": 2 * v, "nodes": v, "edges": 3 * v}
        out.append(e)
    return out


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(12)
    events = [e for i in range(160) for e in events_of(rnd, f"d{i}", rnd.randrange(1, 14))]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return events, spark.createDataFrame([tuple(e[c] for c in names) for e in events], SCHEMA).repartition(4)


def plain(events):
    rows = {}
    for e in sorted(events, key=lambda e: e["event_version"]):
        row = rows.get(e["aggregate_id"], {})
        if row.get("status") != "DELETED":
            rows[e["aggregate_id"]] = R.apply_event(row, e)
    names = [c.split()[0] for c in R.COLUMNS.split(", ")]
    return {k: tuple(r.get(c) for c in names) for k, r in rows.items() if r["status"] != "DELETED"}


def as_rows(df):
    return {r.aggregate_id: tuple(r)[1:] for r in df.collect()}


def cut(df, events, seed, parts):
    """The log in ``parts`` slices, at places of its own in each document."""
    rnd = random.Random(seed)
    places = {e["aggregate_id"]: sorted(rnd.randrange(15) for _ in range(parts - 1)) for e in events}
    table = df.sparkSession.createDataFrame([(k, v) for k, v in places.items()], "id string, places array<int>")
    cut_ = df.join(table, df.aggregate_id == table.id).withColumn("slice", F.size(F.filter("places", lambda p: p < F.col("event_version")))).drop("id", "places")
    return [cut_.filter(F.col("slice") == k).drop("slice") for k in range(parts)]


def test_whole_log(log):
    events, df = log
    assert as_rows(snapshots.rows(snapshots.summary(df))) == plain(events)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split(spark, log, seed):
    events, df = log
    parts = [snapshots.summary(x).cache() for x in cut(df, events, seed, 3)]
    left = snapshots.merge(snapshots.merge(parts[0], parts[1]), parts[2])
    right = snapshots.merge(parts[0], snapshots.merge(parts[1], parts[2]))
    assert as_rows(snapshots.rows(left)) == as_rows(snapshots.rows(right)) == plain(events)
    spark.catalog.clearCache()


def test_a_slice_maps_statuses(log):
    events, df = log
    late = [e for e in events if e["event_version"] > 4]
    for before in ("PENDING_UPLOAD", "UPLOADED", "PARSED", "CHUNKED", "GRAPH_EXTRACTED", "INDEXED", "FAILED", "PROCESSING", "DELETED"):
        want = {}
        for e in sorted(late, key=lambda e: e["event_version"]):
            want[e["aggregate_id"]] = R.step_status(want.get(e["aggregate_id"], before), e["event_type"])
        got = snapshots.summary(df.filter("event_version > 4")).select("aggregate_id", snapshots.status_after(F.lit(before)).alias("status"))
        assert {r.aggregate_id: r.status for r in got.collect()} == want


def test_reads_only_what_came_later(spark, log):
    events, df = log
    at = shared_folder(spark, "log")
    snapshots.store_slices(df.withColumn("slice", F.floor(F.col("event_version") / 4).cast("int")), f"{at}/log")
    first = snapshots.take(spark, f"{at}/log", 1, f"{at}/first")
    second = snapshots.take(spark, f"{at}/log", 2, f"{at}/second", first)
    now = snapshots.current(spark, f"{at}/log", second)
    assert as_rows(now) == plain(events)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plan = snapshots.current(spark, f"{at}/log", second)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [x.split("PartitionFilters: [")[1].split("PushedFilters")[0] for x in plan.split("\n") if "FileScan" in x and "/log]" in x]
    assert scans and all("> 2)" in x for x in scans)


def test_empty_slices(spark, log):
    events, df = log
    none, all_ = snapshots.summary(df.filter("false")), snapshots.summary(df)
    assert none.count() == 0
    assert as_rows(snapshots.rows(snapshots.merge(none, all_))) == as_rows(snapshots.rows(snapshots.merge(all_, none))) == plain(events)
