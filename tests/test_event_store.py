"""Bucketed logs: what is read and shuffled, and the same rows as without."""

import pytest
from pyspark.sql import functions as F

from strataloom.operators import events as E
from strataloom.plans import data as D
from strataloom.sources import event_store


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    log = D.log(spark, "/root/testdata/sf0.001")
    event_store.create(log.filter("event_version <= 3"), "log_store", f"file://{tmp_path_factory.mktemp('log')}/t", buckets=8)
    event_store.append(log.filter("event_version > 3"), "log_store")
    yield log
    spark.sql("DROP TABLE log_store")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_folds_without_exchange(spark, stored):
    df = E.fold_latest(spark.table("log_store"), ["value"])
    df.collect()
    assert "Exchange" not in plan(df)
    key = lambda r: r.aggregate_id
    assert sorted(df.collect(), key=key) == sorted(E.fold_latest(stored, ["value"]).collect(), key=key)


def test_appends_and_joins_without_exchange(spark, stored):
    last = spark.table("log_store").groupBy("aggregate_id").agg(F.max("event_version").alias("base"))
    joined = spark.table("log_store").join(last.hint("merge"), "aggregate_id")
    joined.collect()
    assert "Exchange hashpartitioning" not in plan(joined)
    seen = stored.filter("event_version <= 5").select("aggregate_id", "event_version")
    assert sorted(r.event_id for r in event_store.tail(spark, "log_store", seen).collect()) == sorted(r.event_id for r in stored.filter("event_version > 5").collect())


def test_a_lookup_reads_one_bucket(spark, stored):
    one = stored.first().aggregate_id
    got = event_store.events_of(spark, "log_store", one)
    assert [r.event_id for r in got.collect()] == [r.event_id for r in stored.filter(F.col("aggregate_id") == one).orderBy("event_version").collect()]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't show what it prunes
    try:
        assert "SelectedBucketsCount: 1 out of 8" in plan(event_store.events_of(spark, "log_store", one))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert event_store.events_of(spark, "log_store", -5).count() == 0
