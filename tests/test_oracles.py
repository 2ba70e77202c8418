"""Every query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from strataloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, small, con, name):
    got, want = catalog.queries()[name](spark, small).toPandas(), con.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_calls_at_fractions_of_seconds(spark, con, tmp_path):
    """SQL's cast takes the nearest second, of two as near the even one."""
    at = [0.5, 0.6, 1.5, 2.5, 3599.4, 3599.5, 3600.4, 3600.5, 3601.5, 7199.5]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + to_microseconds({round(s * 1e6)}), {i % 2})" for i, s in enumerate(at * 2))
    con.execute(f"COPY (SELECT i::BIGINT AS event_id, ts, u::BIGINT AS user_id FROM (VALUES {rows}) t(i, ts, u)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    sql = catalog.oracle_sql()["rate_window_usage"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")
    assert rows_of_calls(catalog.queries()["rate_window_usage"](spark, str(tmp_path))) == sorted(con.execute(sql).fetchall())


def rows_of_calls(df):
    return sorted((r.event_id, r.requests, r.tokens_used) for r in df.collect())
