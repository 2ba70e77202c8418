"""Commits happen whole, once, and only at the version that their writer saw."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from strataloom.sources import commits

SCHEMA = "id long, v string, seq long"


def rows_of(spark, at, schema=SCHEMA):
    return sorted(tuple(r) for r in commits.read(spark, at, schema)[0].collect())


def files(at):
    return {x for x in os.listdir(f"{at}/data")} if os.path.isdir(f"{at}/data") else set()


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_append_and_overwrite(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    assert commits.read(spark, at, SCHEMA)[1] == 0 and rows_of(spark, at) == []
    want = []
    for k in range(1, 24):
        commits.write(frame(spark, (k, "x", k)), at, expected=k - 1)
        want.append((k, "x", k))
    assert rows_of(spark, at) == want and commits.state(at).version == 23
    assert rows_of(spark, at) == want and sorted(tuple(r) for r in commits.read(spark, at, SCHEMA, version=12)[0].collect()) == want[:12]
    commits.write(frame(spark, (0, "only", 0)), at, overwrite=True)
    assert rows_of(spark, at) == [(0, "only", 0)]
    commits.write(frame(spark).limit(0), at)
    assert rows_of(spark, at) == [(0, "only", 0)] and commits.state(at).version == 25
    assert commits.clean_up(at, 0) == 23 and rows_of(spark, at) == [(0, "only", 0)] and len(files(tmp_path / "t")) == 1


def test_one_of_two_writers_wins(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    commits.write(frame(spark, (1, "a", 1)), at)
    _, seen = commits.read(spark, at, SCHEMA)
    commits.write(frame(spark, (2, "first", 1)), at, expected=seen)
    before = files(tmp_path / "t")
    with pytest.raises(commits.Conflict):
        commits.write(frame(spark, (3, "second", 1)), at, expected=seen)
    assert rows_of(spark, at) == [(1, "a", 1), (2, "first", 1)] and files(tmp_path / "t") == before


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    bad = spark.range(2000).repartition(4).select("id", F.lit("x").alias("v"), F.when(F.col("id") == 1500, F.raise_error(F.lit("no more")).cast("long")).otherwise(F.col("id")).alias("seq"))
    with pytest.raises(Exception, match="no more"):
        commits.write(bad, at)
    assert commits.state(at).version == 0 and files(tmp_path / "t") == set()


def test_concurrent_appends_number_events(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    schema = "aggregate_id string, kind string, seq long"
    errors = []

    def append(k):
        try:
            commits.append_events(spark.createDataFrame([("a", f"k{k}", 1), ("a", f"k{k}", 2), (f"own{k}", "x", 1)], schema), at)
        except Exception as e:  # told by the assertion below
            errors.append(e)

    threads = [threading.Thread(target=append, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    log = commits.read(spark, at, schema + ", event_version int")[0].collect()
    assert sorted(r.event_version for r in log if r.aggregate_id == "a") == list(range(1, 9)) and len(log) == 12
    for k in range(4):  # an append's events are next to each other
        own = sorted((r.seq, r.event_version) for r in log if r.kind == f"k{k}")
        assert own[1][1] == own[0][1] + 1


def test_upserts_and_deletes(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    commits.upsert(frame(spark, (1, "old", 1), (2, "two", 1), (1, "new", 2)), at, ["id"], "seq")
    commits.upsert(frame(spark, (1, "late", 1), (2, None, 5), (3, "three", 1)), at, ["id"], "seq")
    assert rows_of(spark, at) == [(1, "new", 2), (2, None, 5), (3, "three", 1)]
    commits.delete(spark.createDataFrame([(3,), (3,), (9,)], "id long"), at, SCHEMA)
    assert rows_of(spark, at) == [(1, "new", 2), (2, None, 5)]


def test_a_repeated_batch_of_a_stream(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    commits.register(spark)
    for k in range(3):
        frame(spark, (k, "x", k)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start = lambda checkpoint: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.format(commits.FORMAT).option("path", at).option("stream", "s").option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
    start("c1")
    want = rows_of(spark, at)
    assert len(want) == 3 and commits.state(at).streams == {"s": 2}
    start("c2")  # its checkpoint is lost: all three batches come again
    assert rows_of(spark, at) == want and commits.state(at).version == 3
