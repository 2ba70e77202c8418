"""The pipeline's stages against the operators they call, and queries against their SQL."""

import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from test_operators import plain_groups, plain_tokenizer, rows_of

import corpus_pipeline
from strataloom.llm import packing, quality_fm, queries, shared, toxicity


def test_stages(spark, small):
    docs = shared.table(spark, small, "documents")
    labels = shared.table(spark, small, "labels")
    model, machine = toxicity.train(docs, labels), quality_fm.train(docs, labels)
    (_, toxic), (_, quality), (_, near), (_, pack) = corpus_pipeline.STAGES
    rows = {r.doc_id: r.text for r in docs.collect()}
    one = shared.materialize(toxic(spark, docs, small), "t")
    ids = sorted(rows)
    mild = [i for i, s in zip(ids, model.score([rows[i] for i in ids])) if s < 0.7]
    assert sorted(r.doc_id for r in one.collect()) == mild and one.columns == docs.columns
    two = shared.materialize(quality(spark, one, small), "q")
    good = [i for i, s in zip(mild, quality_fm.score_texts(machine, [rows[i] for i in mild])) if s >= 0.7]
    assert sorted(r.doc_id for r in two.collect()) == good and two.columns == docs.columns
    three = shared.materialize(near(spark, two, small), "n")
    groups = plain_groups([(i, rows[i]) for i in good], 80)
    assert sorted(r.doc_id for r in three.collect()) == [i for i in good if groups[i][1] == i] and three.columns == docs.columns
    four = pack(spark, three, small)
    t = plain_tokenizer(P.path("byte_bpe_50k.json"))
    assert sum(r.length for r in four.collect()) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in rows_of(three))
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()}


def test_quality_features_reach_the_driver_in_parts(spark, monkeypatch):
    # a job may send the driver less than all features have, so one collect of them fails
    monkeypatch.setattr(quality_fm, "EPOCHS", 1)
    monkeypatch.setattr(quality_fm, "STEPS", 1)
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, " ".join(map(str, rng.integers(0, 1 << 40, 3000))), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(8)
    docs = shared.materialize(docs, "long-texts")
    conf, key = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    conf.set(key, "2m")
    try:
        got = quality_fm.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    finally:
        conf.remove(key)
    own = sorted((i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    i, x = quality_fm.features([t for _, t, _ in own])
    assert sum(a.nbytes + b.nbytes for a, b in zip(i, x)) > 4 << 20
    want = quality_fm.fit(i, x, np.array([y for _, _, y in own], dtype=np.float64))
    assert got.bias == want.bias and np.array_equal(got.weights, want.weights) and np.array_equal(got.factors, want.factors)


def test_run(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0


def test_sequences_to_train_on(spark, small):
    rows = corpus_pipeline.sequences(spark, small).collect()
    assert {len(r.ids) for r in rows} == {4 * 2048}
    assert sum(r.n for r in rows) == corpus_pipeline.run(spark, small).groupBy().sum("length").first()[0]


def test_stages_on_an_empty_table(spark, small):
    docs = shared.table(spark, small, "documents").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.materialize(stage(spark, docs, small), name)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, small).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)  # noqa: E731  a column of numbers with nulls
    row = lambda df: sorted(tuple(plain(v) for v in r) for r in df[sorted(want.columns)].replace({np.nan: None}).itertuples(index=False))
    assert row(got) == row(want)


def test_the_querys_rules_are_those_of_its_contract(spark, tmp_path):
    # words written out here, not taken from QUERY_RULES; a page of few words is listed, so without its rule it would be blocked
    want = [
        ("http://a.com/en/1", "com/en/", "block"), ("http://example.com/en/6", "com/en/", "block"), ("http://m.example.com/en/71", "example.com/en/7", "allow"),
        ("http://a.net/de/1", "net/de/", "allow"), ("http://m.example.net/de/7", "net/de/", "allow"), ("http://m.example.net/de/81", "example.net/de/8", "block"),
        ("http://a.org/es/1", "org/es/", "block"), ("http://a.org/de/1", None, "block"),
    ]
    spark.createDataFrame([(i, url, "<p>few words</p>") for i, (url, _, _) in enumerate(want)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.queries()["op10_url_filter"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(want[r.page_id][0], r.rule, r.verdict) for r in got] == want


def test_every_operator_has_a_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_packing_fills_windows(spark, small):
    got = packing.pack(shared.table(spark, small, "documents"), P.path("byte_bpe_50k.json")).groupBy("sequence_id").sum("length").collect()
    short = [r for r in got if r[1] != 2048]
    assert len(short) <= 1
