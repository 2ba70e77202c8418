import hashlib
import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strataloom.operators import events as E
from strataloom.operators import discovery, lifecycle, sync
from strataloom.operators import read_model as R
from strataloom.sources import files
from strataloom.sources.change_feed import LocalFolder, listing_of
from strataloom.streaming import native, projector

KINDS = [R.ATTACHED, R.STORED, R.PARSED, R.PROGRESS, *R.RESETS]


def random_log(spark, deleted=False):
    rnd, rows = random.Random(11), []
    for a in range(300):
        kinds = [rnd.choice(KINDS) for _ in range(rnd.randrange(1, 9))]
        if deleted and a % 10 == 0:
            kinds.insert(rnd.randrange(len(kinds) + 1), E.DELETED)
        rows += [(f"a{a}", k, v, f"a{a}-{v}") for v, k in enumerate(kinds, 1)]
    rnd.shuffle(rows)
    want = {}
    for a, k, _, _ in sorted(rows, key=lambda r: (r[0], r[2])):
        want[a] = R.step_status(want.get(a), k)
    return spark.createDataFrame(rows, "aggregate_id string, event_type string, event_version int, event_id string"), want


def test_status_equals_the_fold(spark):
    log, want = random_log(spark, deleted=True)
    got = {r.aggregate_id: r.status for r in E.document_status(log).collect()}
    assert got == {a: s for a, s in want.items() if s != "DELETED"}


def whole_log(spark):
    """Random logs with payloads, and what plain code makes of them."""
    rnd, rows = random.Random(12), []
    for a in range(200):
        for v in range(1, rnd.randrange(2, 14)):
            kind = rnd.choice([R.ATTACHED, R.STORED, R.PARSED, R.FAILED, R.CHUNKED, R.EXTRACTED, R.INDEXED, *[R.PROGRESS] * 5] + [R.DELETED] * (rnd.random() < 0.2))
            rows.append({"aggregate_id": f"a{a}", "event_type": kind, "event_version": v, "file_name": f"f{v}", "storage_path": f"s{v}", "enable_ocr": rnd.random() < 0.5, "ocr_instructions": None, "step": rnd.choice(["CHUNKING", "OCR", "INDEXING"]), "error_message": f"e{v}", "current": v, "total": 20, "percentage": rnd.randrange(101), "message": f"m{v}", "total_parents": v, "total_children": 2 * v, "nodes": v, "edges": v + 1})
    want: dict = {}
    for e in rows:
        want[e["aggregate_id"]] = R.apply_event(want.get(e["aggregate_id"], {}), e)
    rnd.shuffle(rows)
    schema = "aggregate_id string, event_type string, event_version int, " + ", ".join(f"{k} {v}" for k, v in R.PAYLOAD.items())
    names = [c.split()[0] for c in R.COLUMNS.split(", ")]
    want = {a: tuple(r.get(c) for c in names) for a, r in want.items() if r["status"] != "DELETED"}
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(3), want, names


def test_read_model_equals_the_fold(spark):
    log, want, names = whole_log(spark)
    got = {r.aggregate_id: tuple(r[c] for c in names) for r in R.documents(log).collect()}
    assert got == want


def test_stream_equals_the_fold(spark):
    log, want, names = whole_log(spark)
    got = {r.aggregate_id: tuple(r[c] for c in names) for r in native.stream_documents(spark, log).collect()}
    assert got == want
    plain, status = random_log(spark)
    assert {r.aggregate_id: r.status for r in native.stream_status(spark, plain.repartition(3)).collect()} == status


def test_progress_telemetry(spark):
    """A failure is cleared by progress, parsing begins a new step at 0, and told progress of one step never falls."""
    p = {c: None for c in R.PAYLOAD}
    rows = [(R.ATTACHED, p | {"file_name": "x.pdf"}), (R.STORED, p), (R.FAILED, p | {"step": "OCR", "error_message": "bad"}), (R.PROGRESS, p | {"step": "OCR", "current": 2, "total": 4, "percentage": 50}), (R.PROGRESS, p | {"step": "OCR", "current": 1, "total": 4, "percentage": 25})]
    schema = "aggregate_id string, event_type string, event_version int, " + ", ".join(f"{k} {v}" for k, v in R.PAYLOAD.items())
    df = spark.createDataFrame([("d", k, v, *x.values()) for v, (k, x) in enumerate(rows, 1)], schema)
    r = R.documents(df.filter("event_version <= 3")).first()
    assert (r.status, r.error_step, r.error_message) == ("FAILED", "OCR", "bad")
    r = R.documents(df).first()
    assert (r.status, r.error_step, r.progress_current, r.progress_percentage, r.file_name) == ("PROCESSING", None, 1, 50, "x.pdf")
    after = df.unionByName(spark.createDataFrame([("d", R.CHUNKED, 6, *(p | {"total_parents": 3, "total_children": 9}).values())], schema))
    r = R.documents(after).first()
    assert (r.status, r.progress_step, r.progress_total, r.progress_percentage, r.total_children) == ("CHUNKED", "EMBEDDINGS", 9, 0, 9)


def test_streaming_barrier_releases_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    t = lambda *rows: spark.createDataFrame(rows, "document_id string, step string, task_id string, total int").withColumn("occurred_at", F.lit("2026-01-01").cast("timestamp"))
    schema = t(("", "", "", 0)).schema
    for k, part in enumerate([t(("d", "s", "t1", 2), ("d", "s", "t1", 2), ("e", "s", None, 0)), t(("d", "s", "t2", 2)), t(("d", "s", "t2", 2), ("e", "s", None, 0))]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        native._drained(projector.released_steps(stream), "append", str(tmp_path), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")))
        want = [("e", 0)] if k == 0 else [("d", 2), ("e", 0)]
        assert sorted((r.document_id, r.completed) for r in spark.read.schema("document_id string, step string, completed int").parquet(str(tmp_path / "out")).collect()) == want


def test_streaming_swap(spark, tmp_path):
    spark.createDataFrame([("n", "o"), ("n", "o"), ("x", None), ("y", "y")], "document_id string, replaces_doc_id string").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("document_id string, replaces_doc_id string").parquet(str(tmp_path / "in"))
    projector.swap_stream(stream, lambda gone, n: seen.extend(r.doc_id for r in gone.collect()), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == ["o"]


def test_stream_of_runs_and_messages(spark, tmp_path):
    outcomes = [("r1", "d1", "indexed", 2), ("r1", "d1", "indexed", 2), ("r1", "d2", "failed", 2), ("r2", "d1", "indexed", 2), (None, "d1", "indexed", 1), ("r3", "d9", "failed", 1)]
    df = spark.createDataFrame(outcomes, "run_id string, document_id string, outcome string, total_files int")
    projector.publish(df).coalesce(1).write.text(str(tmp_path / "in"))
    (tmp_path / "in" / "broken.txt").write_text("not json\n")
    stream = projector.consume(spark.readStream.text(str(tmp_path / "in")), "run_id string, document_id string, outcome string, total_files int")
    native._drained(projector.project_runs(stream), "append", str(tmp_path), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")))
    got = {r.run_id: (r.status, r.indexed_files, r.failed_files) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"r1": ("PARTIALLY_FAILED", 1, 1), "r3": ("FAILED", 0, 1)}


def test_runs_count_last_words(spark, tmp_path):
    schema = "run_id string, document_id string, outcome string, total_files int, seq int"
    batches = [[("r", "a", "indexed", 3, 5), ("r", "b", "failed", 3, 1), ("r", None, None, 3, 1), ("s", "a", "failed", 2, 1)], [("r", "a", "failed", 3, 4), ("r", "b", "indexed", 3, 2), ("s", "a", "indexed", 2, 2)], [("r", "c", "failed", 3, 1), ("s", "b", "indexed", 2, 1)], [("r", "c", "indexed", 3, 9)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(next((tmp_path / f"p{k}").glob("*.parquet")), tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    native._drained(projector.project_runs(stream), "append", str(tmp_path), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("r", "PARTIALLY_FAILED", 2, 1), ("s", "COMPLETED", 2, 0)]


def test_stream_delivers_once(spark):
    t = datetime(2026, 1, 1)
    df = spark.createDataFrame([(i, t + timedelta(seconds=i)) for i in range(50)], "event_id int, occurred_at timestamp")
    assert native.stream_once(spark, df).count() == 50


def test_change_feed(spark, tmp_path):
    spark.dataSource.register(LocalFolder)
    top = tmp_path / "f"
    (top / "sub").mkdir(parents=True)
    (top / "a.txt").write_text("one")
    (top / "sub" / "b.txt").write_text("two")
    read = lambda **o: spark.read.format("local_folder").options(path=str(top), **o).load()
    first = {r.external_id: r for r in read().collect()}
    assert set(first) == {"a.txt", "sub/b.txt"} and first["a.txt"].version_hash == hashlib.sha256(b"one").hexdigest()
    newest = max(r.modified_ns for r in first.values())
    stream = spark.readStream.format("local_folder").option("path", str(top)).load()

    def told():
        stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.external_id, r.removed) for r in spark.read.parquet(str(tmp_path / "o")).collect())

    assert told() == [("a.txt", False), ("sub/b.txt", False)]
    for name, at in (("c.txt", newest), ("old.txt", newest - 10**12)):  # the same time as the last file seen, and an older one
        (top / name).write_text(name)
        os.utime(top / name, ns=(at, at))
    (top / "sub" / "b.txt").unlink()
    assert told() == [("a.txt", False), ("c.txt", False), ("old.txt", False), ("sub/b.txt", False), ("sub/b.txt", True)]
    assert told() == [("a.txt", False), ("c.txt", False), ("old.txt", False), ("sub/b.txt", False), ("sub/b.txt", True)]
    (top / "d.txt").write_text("three")
    os.utime(top / "d.txt", ns=(newest + 10**9,) * 2)
    assert [r.name for r in read(since_ns=newest).collect()] == ["d.txt"]
    known = tmp_path / "known.json"
    known.write_text(json.dumps(listing_of(str(top)) | {"gone.txt": [1, 1]}))
    (top / "e.txt").write_text("four")
    assert sorted((r.external_id, r.removed) for r in read(known=str(known)).collect()) == [("e.txt", False), ("gone.txt", True)]


def test_append_and_conflicts(spark):
    log = spark.createDataFrame([("a", 1), ("a", 2)], "aggregate_id string, event_version int")
    batch = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "aggregate_id string, seq int")
    got = sorted((r.aggregate_id, r.event_version) for r in E.number_events(batch, log).collect())
    assert got == [("a", 3), ("a", 4), ("b", 1)]
    assert E.append(log.unionByName(spark.createDataFrame([("a", 3)], "aggregate_id string, event_version int")), log).count() == 1
    c = spark.createDataFrame([("a", 2), ("a", 1), ("c", 0)], "aggregate_id string, expected_version int")
    assert [r.conflict for r in E.check_versions(c, log).orderBy("aggregate_id", F.desc("expected_version")).collect()] == [False, True, False]


def test_progress(spark):
    u = spark.createDataFrame([("d", v, s, p) for v, (s, p) in enumerate([("A", 10), ("A", 5), ("B", 3), ("B", 9), ("A", 1)])], "document_id string, version int, step string, percentage int")
    assert [r.shown for r in E.progress(u).orderBy("version").collect()] == [10, 10, 3, 9, 1]
    p = spark.createDataFrame([(1, 3, False), (3, 3, False), (3, 3, True), (0, 0, False)], "c int, t int, d boolean")
    assert [r[0] for r in p.select(E.percentage(F.col("c"), F.col("t"), F.col("d"))).collect()] == [33, 99, 100, 0]


def test_runs(spark):
    rows = [("r1", "a", "indexed", 3, 1), ("r1", "b", "indexed", 3, 2), ("r1", "b", "indexed", 3, 3), ("r1", "c", "failed", 3, 4), ("r2", "a", "failed", 1, 1), ("r3", None, None, 0, 1), ("r4", "a", "indexed", 2, 1), ("r5", "a", "failed", 1, 1), ("r5", "a", "indexed", 1, 2)]
    got = {r.run_id: r.status for r in sync.run_accounting(spark.createDataFrame(rows, "run_id string, document_id string, outcome string, total_files int, seq int")).collect()}
    assert got == {"r1": "PARTIALLY_FAILED", "r2": "FAILED", "r3": "COMPLETED", "r4": "RUNNING", "r5": "COMPLETED"}


def test_recovery(spark):
    t = datetime(2026, 1, 1)
    docs = spark.createDataFrame([("a", "UPLOADED", t, 0), ("b", "PARSED", t, 2), ("c", "INDEXED", t, 0), ("d", "CHUNKED", t + timedelta(hours=2), 0), ("e", "PARSED", t, 3), ("f", "RECOVERING", t, 1)], "id string, status string, updated_at timestamp, recovery_attempt int")
    stale = E.stale_documents(docs, F.lit(t + timedelta(hours=1)))
    assert [r.id for r in stale.collect()] == ["a", "b", "f"]
    seen = stale.withColumn("recovery_attempt", F.when(F.col("id") == "f", 0).otherwise(F.col("recovery_attempt")))
    got = {r.id: (r.status, r.recovery_attempt) for r in E.recover(docs, seen).collect()}
    assert got["a"] == ("RECOVERING", 1) and got["b"] == ("FAILED", 3) and got["f"] == ("RECOVERING", 1) and got["c"] == ("INDEXED", 0)


def test_sync_rules(spark):
    items = spark.createDataFrame([("e1", "h1", "x.md", 10), ("e2", "h2", "y.md", 60 * 2**20), ("e3", "h3", "x.md", None)], "external_id string, version_hash string, file_name string, size_bytes long")
    have = spark.createDataFrame([("e1", "h1", "INDEXED"), ("e2", "h0", "INDEXED"), ("e3", "h3", "FAILED")], "external_id string, version_hash string, status string")
    assert sorted(r.external_id for r in sync.gate(items, have).collect()) == ["e2", "e3"]
    load, dead = sync.by_size(items)
    assert load.count() == 2 and dead.first().error == "file exceeds 50 MiB"
    docs = spark.createDataFrame([("x.md", "old", 1), ("x.md", "newer", 2)], "file_name string, doc_id string, ord int")
    assert {r.replaces_doc_id for r in sync.replaces(items, docs).collect()} == {"newer", None}
    runs = spark.createDataFrame([("s", 1, "c1", 0), ("s", 2, "c2", 3), ("t", 1, "c1", 1), ("t", 2, "c2", 0)], "source_id string, seq int, new_cursor string, failed int")
    assert {r.source_id: (r.cursor, r.pending_cursor) for r in sync.next_cursor(runs).collect()} == {"s": ("c1", "c2"), "t": ("c2", None)}
    dead = spark.createDataFrame([("d", "e"), (None, "e"), ("", None)], "doc_id string, external_id string")
    assert [r.route for r in sync.retry_routes(dead).collect()] == ["reprocess", "download", "unrecoverable"]
    fails = spark.createDataFrame([("e1", "x")], "external_id string, error string")
    assert sync.reconcile(fails, spark.createDataFrame([("e1", "y"), ("e2", "z")], "external_id string, error string")).count() == 2


def test_folders_with_cycles_and_many_ways(spark, tmp_path):
    links = [(None, "root"), ("root", "a"), ("a", "b"), ("b", "root"), ("y", "z")]
    links += [(f"{x}{k}", f"{y}{k + 1}") for k in range(12) for x in "lr" for y in "lr"] + [("root", "l0"), ("root", "r0")]  # 4096 ways down
    df = spark.createDataFrame(links, "parent_id string, folder_id string")
    got = {r.folder_id: r.depth for r in discovery.walk(df, "root", str(tmp_path)).collect()}
    assert got == {"root": 0, "a": 1, "b": 2} | {f"{x}{k}": k + 1 for k in range(13) for x in "lr"}
    assert [r.folder_id for r in discovery.walk(df, "root", str(tmp_path), recursive=False).collect()] == ["root"]


LISTING = "file_id string, parent_id string, name string, mime_type string, modified_time string, size long, md5 string, version string, shortcut_target string, shortcut_mime string, trashed boolean"


def test_baseline_of_a_folder(spark, tmp_path):
    text, now = "text/plain", F.lit("2026-01-31").cast("timestamp")
    f = lambda i, parent, mime=text, time="2026-01-30T00:00:00Z", md5=None, version=None, target=None, kind=None, trashed=None: (i, parent, i.upper(), mime, time, 5, md5, version, target, kind, trashed)
    rows = [
        f("sub", "root", discovery.FOLDER), f("a", "root", md5="m"), f("b", "sub", version="7"), f("c", "sub", time="2026-01-30T00:00:00.5+00:00"), f("late", "sub", time="never"), f("old", "sub", time="2025-12-01T00:00:00Z"),
        f("png", "root", "image/png"), f("s1", "root", discovery.SHORTCUT, target="t1", kind=text), f("s2", "sub", discovery.SHORTCUT, target="t1", kind=text), f("s3", "root", discovery.SHORTCUT, target="far", kind=discovery.FOLDER),
        f("s4", "root", discovery.SHORTCUT, kind=text), f("deep", "far"), f("bin", "root", trashed=True), f("back", "sub", discovery.SHORTCUT, target="root", kind=discovery.FOLDER), f("out", "else"),
    ]
    df = spark.createDataFrame(rows, LISTING)
    got = {r.external_id: r for r in discovery.baseline(df, "root", str(tmp_path), [text], 30, now).collect()}
    assert set(got) == {"a", "b", "c", "late", "t1", "deep"}
    assert (got["a"].version_hash, got["b"].version_hash, got["c"].version_hash, got["late"].version_hash) == ("m", "7", "1769731200", "1769817600")
    assert got["t1"].name == "S1" and got["a"].size_bytes == 5
    assert {r.external_id for r in discovery.baseline(df, "root", str(tmp_path), [], 0, now, recursive=False).collect()} == {"a", "png", "t1"}
    changes = spark.createDataFrame([(*f("a", "sub"), False, 1), (*f("a", "else"), False, 2), (*f("b", "sub"), True, 1), (*f("c", "sub", trashed=True), None, 1), (*f("d", "sub"), False, 1), (*f("png2", "root", "image/png"), False, 1)], LISTING + ", removed boolean, seq int")
    kept, gone = discovery.delta(changes, spark.createDataFrame([("root",), ("sub",)], "folder_id string"), [text], now)
    assert [r.external_id for r in kept.collect()] == ["d"] and sorted(r.file_id for r in gone.collect()) == ["b", "c"]
    assert [r[0] for r in spark.createDataFrame([(k,) for k in discovery.EXPORTS] + [("x/y",)], "m string").select(discovery.exported(F.col("m"))).collect()] == ["text/plain", "text/csv", "x/y"]
    known = discovery.Connectors()
    known.add("folder", "it")
    assert known.of("folder") == "it"
    with pytest.raises(KeyError):
        known.of("other")


def sources(spark, **status):
    return spark.createDataFrame([(k, "kb", v, "c0", None) for k, v in status.items()], "source_id string, kb_id string, status string, cursor string, pending_cursor string")


def test_sync_of_sources(spark):
    req = spark.createDataFrame([("s", "kb", "r"), ("empty", None, "re"), ("busy", "kb", "rb"), ("off", "kb", "ro"), ("s2", "other", "r2"), ("lost", "kb", "rl")], "source_id string, kb_id string, run_id string")
    src = sources(spark, s="IDLE", empty="FAILED", busy="SYNCING", off="DISABLED", s2="IDLE")
    items = spark.createDataFrame([("s", "e1", "dir/same.md", "h1", 1), ("s", "e2", "new.md", "h2", 1), ("s", "e3", "big.md", "h3", 60 << 20), ("s", "e4", "gone.md", "h4", 1), ("s", "e5", "changed.md", "h5", 1), ("busy", "e9", "x", "h", 1)], "source_id string, external_id string, name string, version_hash string, size_bytes long").withColumn("mime_type", F.lit("text/plain"))
    cursors = spark.createDataFrame([("s", "c1"), ("empty", "c1")], "source_id string, next_cursor string")
    docs = spark.createDataFrame([("kb", "d1", "same.md", "e1", "h1", "INDEXED", 1), ("kb", "d5", "changed.md", "e5", "h0", "INDEXED", 2), ("kb", "d6", "new.md", None, None, "FAILED", 3), ("kb", "d7", "z", "e7", "h", "INDEXED", 4)], "kb_id string, doc_id string, file_name string, external_id string, version_hash string, status string, ord int")
    contents = spark.createDataFrame([(e, bytearray(e.encode())) for e in ("e1", "e2", "e3", "e5")], "external_id string, content binary")
    gone = spark.createDataFrame([("s", "e7"), ("busy", "e1")], "source_id string, external_id string")
    t = sync.sync_sources(req, src, items, cursors, docs, lambda x: discovery.loaded(x, contents), deleted=gone)
    assert {r.run_id: r.error for r in t["rejected"].collect()} == {"rb": sync.SYNCING, "ro": sync.DISABLED, "r2": sync.NOT_FOUND, "rl": sync.NOT_FOUND}
    assert {r.run_id: (r.total_files, r.indexed_files, r.failed_files, r.status) for r in t["runs"].collect()} == {"r": (5, 1, 2, "INGESTING"), "re": (0, 0, 0, "COMPLETED")}
    assert {r.source_id: (r.status, r.cursor, r.pending_cursor) for r in t["sources"].collect()} == {"s": ("IDLE", "c0", "c1"), "empty": ("IDLE", "c1", None)}
    assert {r.file_name: (r.error, r.external_id) for r in t["failures"].collect()} == {"big.md": ("File 'big.md' exceeds maximum allowed size (62914560 > 52428800 bytes)", "e3"), "gone.md": ("no content of 'gone.md'", "e4")}
    made = {r.file_name: r for r in t["attached"].collect()}
    assert {k: (r.replaces_doc_id, r.byte_size, r.status) for k, r in made.items()} == {"new.md": ("d6", 2, "UPLOADED"), "changed.md": ("d5", 2, "UPLOADED")}
    assert made["new.md"].storage_path == f"kb/kb/raw/{made['new.md'].document_id}-new.md" and (made["new.md"].version_hash, made["new.md"].content_hash) == ("h2", hashlib.sha256(b"e2").hexdigest())
    assert {r.document_id for r in t["attached"].collect()} == {r.document_id for r in made.values()}
    assert [r.doc_id for r in t["removed"].collect()] == ["d7"]
    assert sorted((r.aggregate_id, r.event_type, r.synced_files, r.new_cursor) for r in t["events"].filter("aggregate_id = 's'").collect()) == [("s", "DataSourceSyncCompleted", 5, "c0"), ("s", "DataSourceSyncStarted", None, None)]
    events = lifecycle.attach_events(t["attached"]).filter("file_name = 'new.md'").collect()
    assert [(e.event_type, e.event_version) for e in sorted(events, key=lambda e: e.event_version)] == [(R.ATTACHED, 1), (R.STORED, 2)]


def test_retry_promotes_the_pending_cursor(spark):
    req = spark.createDataFrame([("s", "kb", "r"), ("u", "kb", "q"), ("busy", "kb", "rb"), ("s", "kb", "none")], "source_id string, kb_id string, run_id string")
    src = sources(spark, s="IDLE", u="IDLE", busy="SYNCING").withColumns({"pending_cursor": F.lit("c1"), "pending_run_id": F.lit("r")})
    runs = spark.createDataFrame([("r", "s", 3, 1), ("q", "u", 3, 0), ("rb", "busy", 1, 0)], "run_id string, source_id string, total_files int, indexed_files int")
    dead = spark.createDataFrame([("r", "s", "d1", "a", None), ("r", "s", None, "b", "e2"), ("q", "u", "d9", "a", None), ("q", "u", None, "b", "e3"), ("q", "u", None, "c", None)], "run_id string, source_id string, doc_id string, file_name string, external_id string")
    dead = dead.withColumns({"error": F.lit("x"), "mime_type": F.lit("text/plain"), "version_hash": F.lit("h"), "size_bytes": F.lit(1).cast("long")})
    contents = spark.createDataFrame([("e2", bytearray(b"x"))], "external_id string, content binary")
    ok = spark.createDataFrame([("d1", True), ("d9", False)], "document_id string, accepted boolean")
    t = sync.retry_failed(req, src, runs, dead, ok, lambda x: discovery.loaded(x.withColumn("name", F.col("file_name")), contents))
    assert {r.run_id: (r.reprocessed_count, r.indexed_files, r.failed_files, r.status) for r in t["runs"].collect()} == {"r": (2, 3, 0, "COMPLETED"), "q": (0, 0, 3, "FAILED")}
    assert {r.source_id: (r.cursor, r.pending_cursor) for r in t["sources"].collect()} == {"s": ("c1", None), "u": ("c0", "c1")}
    assert sorted(r.file_name for r in t["failures"].collect()) == ["a", "b", "c"] and [r.file_name for r in t["attached"].collect()] == ["b"]
    assert {r.run_id: r.error for r in t["rejected"].collect()} == {"rb": "CONCURRENCY_CONFLICT", "none": "NOT_FOUND"}


def test_reprocess(spark):
    log = spark.createDataFrame([("a", R.ATTACHED, 1), ("a", R.FAILED, 2), ("b", R.DELETED, 1)], "aggregate_id string, event_type string, event_version int")
    docs = spark.createDataFrame([("a", "a.md", "s/a"), ("c", "c.docx", "s/c")], "document_id string, file_name string, storage_path string")
    req = spark.createDataFrame([("kb", "a"), ("kb", "b"), ("kb", "c"), ("kb", "d"), ("no", "a")], "kb_id string, document_id string")
    answers, events = lifecycle.reprocess(req.filter("kb_id = 'kb'"), log, docs, spark.createDataFrame([("kb",)], "kb_id string"))
    assert {r.document_id: (r.accepted, r.error) for r in answers.collect()} == {"a": (True, None), "b": (False, "INVALID_STATE"), "c": (True, None), "d": (False, "NOT_FOUND")}
    assert sorted((r.aggregate_id, r.event_version, r.event_type) for r in events.collect()) == [("a", 3, R.STORED), ("c", 1, R.ATTACHED), ("c", 2, R.STORED)]
    assert [r.content_type for r in events.filter("content_type is not null").collect()] == ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"]
    assert [r.error for r in lifecycle.reprocess(req.filter("kb_id = 'no'"), log, docs, spark.createDataFrame([("kb",)], "kb_id string"))[0].collect()] == ["NOT_FOUND"]
    after = R.document_status(log.unionByName(events.select("aggregate_id", "event_type", "event_version")))
    assert {r.aggregate_id: r.status for r in after.collect()} == {"a": "UPLOADED", "c": "UPLOADED"}


def test_bases_and_sources(spark):
    onto = spark.createDataFrame([("o1", "law"), ("o2", "law"), ("o3", "art")], "ontology_id string, name string")
    req = spark.createDataFrame([("k1", " K ", "d", "o3", None), ("k2", "K", None, None, "law"), ("k3", "K", None, None, "own"), ("k4", "K", None, "o9", None), ("k5", "K", None, None, None), ("k6", " ", None, "o1", None)], "kb_id string, name string, description string, ontology_id string, ontology_name string")
    made, bad = lifecycle.create_bases(req, onto)
    assert {r.kb_id: (r.name, r.ontology_id) for r in made.collect()} == {"k1": ("K", "o3"), "k2": ("K", "o1"), "k3": ("K", None)}
    assert {r.kb_id: r.error for r in bad.collect()} == {"k4": "ONTOLOGY_NOT_FOUND", "k5": "ONTOLOGY_REQUIRED", "k6": "INVALID_NAME"}
    old = spark.createDataFrame([("k3", "old", "x", "ACTIVE", "kb/k3", "o1"), ("k9", "stays", "", "ACTIVE", "p", None)], "kb_id string, name string, description string, status string, storage_partition string, ontology_id string")
    assert {r.kb_id: (r.name, r.ontology_id) for r in lifecycle.upsert_bases(old, made).collect()} == {"k1": ("K", "o3"), "k2": ("K", "o1"), "k3": ("K", "o1"), "k9": ("stays", None)}
    s = spark.createDataFrame([("s1", "k9", "n", " root ", None), ("s2", "k9", "n", "a/b", 1), ("s3", "zz", "n", "x", 1), ("s4", "k9", "n", "x", -1)], "source_id string, kb_id string, name string, folder_id string, baseline_days int")
    made, bad = lifecycle.create_sources(s, old)
    assert [(r.source_id, r.folder_id, r.baseline_days) for r in made.collect()] == [("s1", "root", 30)]
    assert {r.source_id: r.error for r in bad.collect()} == {"s2": "INVALID_CONFIG", "s3": "NOT_FOUND", "s4": "INVALID_CONFIG"}
    assert lifecycle.folder_config('{"folder_id": " f1 "}')["folder_id"] == "f1"
    for wrong in ('{"folder_id": ""}', '{"folder_id": "a b"}', '{"folder_id": "a", "more": 1}', '{"folder_id": "a", "baseline_days": -1}'):
        with pytest.raises(ValueError):
            lifecycle.folder_config(wrong)
    log = spark.createDataFrame([("k9", "KnowledgeBaseDeleted")], "aggregate_id string, event_type string")
    bases, docs = lifecycle.archive(old, spark.createDataFrame([("k3", "d1"), ("k9", "d2")], "kb_id string, document_id string"), log)
    assert {r.kb_id: r.status for r in bases.collect()} == {"k3": "ACTIVE", "k9": "ARCHIVED"} and [r.document_id for r in docs.collect()] == ["d1"]
    detail = spark.createDataFrame([("k", "b", 2), ("k", "a", 1), ("l", "c", 0)], "kb_id string, document_id string, created_at int")
    assert [r.document_id for r in lifecycle.base_detail(detail, "k").collect()] == ["a", "b"]
    log = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "aggregate_id string, event_version int")
    assert [r.event_version for r in files.events_of(log, "a").collect()] == [1, 2]
    runs = spark.createDataFrame([("s", f"r{i}", i) for i in range(5)] + [("t", "x", 9)], "source_id string, run_id string, started_at int")
    assert [r.run_id for r in lifecycle.list_runs(runs, "s", 2).collect()] == ["r4", "r3"]
    with pytest.raises(ValueError):
        lifecycle.list_runs(runs, "s", 201)
    up = spark.createDataFrame([("a.PDF", 1), ("a.PDF", 1), ("a.PDF", 2), ("b.exe", 1)], "name string, size int")
    assert lifecycle.uploads(up, (".pdf",)).count() == 2
    ids = spark.createDataFrame([("0A8B1C2D-0000-4000-8000-000000000001",), ("nope",), (None,)], "t string").select(lifecycle.valid_uuid(F.col("t"))).collect()
    assert [r[0] for r in ids] == ["0a8b1c2d-0000-4000-8000-000000000001", None, None]
    one = spark.range(1).select(lifecycle.uuid_of(F.lit("a"), F.lit(None)).alias("u"), lifecycle.shown_evidence(F.lit("A"), F.array(F.lit("x y z"), F.lit("x y z"))).alias("e"), lifecycle.shown_hit(F.lit("f"), F.lit("t"), F.lit("title"), F.lit(1), F.lit("p")).alias("h"), lifecycle.shown_base(F.lit("n"), F.lit("k"), F.lit(None), F.lit("ACTIVE"), F.lit(2)).alias("b")).first()
    assert len(one.u) == 36 and one.e == "A\n\n### Evidências do Grafo\n- **Relações no Grafo (Triplas)**:\n  - x y z"
    assert one.h == "- **f** | Seção: *t* (`title`)\n  - Document ID: `1`\n  - Trecho: p" and one.b == "- **n** (`k`)\n  - Descrição: \n  - Status: ACTIVE\n  - Documentos: 2"


def test_barrier_counts_tasks_once(spark):
    t = spark.createDataFrame([("d", "s", "t1", 2), ("d", "s", "t1", 2), ("e", "s", "t1", 1), ("e", "s", "t2", 1), ("f", "s", None, 0)], "document_id string, step string, task_id string, total int")
    assert {r.document_id: r.released for r in sync.barrier(t).collect()} == {"d": False, "e": True, "f": True}


def test_watchdog_tells_of_silence(spark, tmp_path):
    t = datetime(2026, 1, 1)
    schema = "aggregate_id string, event_type string, event_version int, occurred_at timestamp"
    batches = [
        [("stuck", R.STORED, 1, t), ("fine", R.STORED, 1, t)],
        [("fine", "DocumentKnowledgeIndexed", 2, t + timedelta(minutes=5)), ("clock", "DocumentAttached", 1, t + timedelta(hours=1))],
        [("clock", "DocumentProcessingFailed", 2, t + timedelta(hours=2))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        name = next(x for x in os.listdir(tmp_path / f"p{k}") if x.endswith(".parquet"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(tmp_path / f"p{k}" / name, tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    native._drained(projector.stuck_documents(stream, 10), "append", str(tmp_path), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")))
    assert [(r.aggregate_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("stuck", "UPLOADED")]


def test_fan_out(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = projector.fan_out(spark.readStream.schema("x int").parquet(str(tmp_path / "in")), [lambda b, n: seen.append(b.count()), lambda b, n: seen.append(b.agg(F.sum("x")).first()[0])], str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert seen == [2, 3]
