"""Functions called from SQL text against the same as columns and tables."""

import pytest
from pyspark.sql import functions as F

from strataloom.functions import sql, vectors
from strataloom.functions import text as T
from strataloom.operators import markdown

DOCS = "document_id string, document_name string, text string"


@pytest.fixture(scope="module")
def docs(spark):
    sql.register(spark)
    sql.register(spark)
    df = spark.createDataFrame([("a", "a.md", "# Títle\n\n" + "One. Two. " * 400 + "\n\n| x |\n"), ("b", "b.md", ""), ("c", "c.md", None), ("d", None, "## Ü\n\nshort")], DOCS)
    df.createOrReplaceTempView("sql_docs")
    yield df
    spark.catalog.dropTempView("sql_docs")


def rows(df):
    return sorted(map(str, df.collect()))


def test_tables(spark, docs):
    names = ["document_id", "parent_id", "child_id", "chunk_index", "header_path", "content"]
    got = spark.sql("SELECT d.document_id, c.* FROM sql_docs d, LATERAL markdown_children(d.document_id, d.document_name, d.text) c")
    assert rows(got.select(*names)) == rows(markdown.child_table(docs).select(*names)) and got.count() > 5
    names = ["document_id", "parent_id", "header_path", "content", "token_count", "part", "total_parts"]
    got = spark.sql("SELECT d.document_id, c.* FROM sql_docs d, LATERAL markdown_parents(d.document_id, d.document_name, d.text, 300) c")
    assert rows(got.select(*names)) == rows(markdown.parent_table(docs, markdown.Limits(parent_tokens=300)).select(*names))
    assert spark.sql("SELECT b.kind FROM sql_docs d, LATERAL markdown_blocks(d.text) b").count() == markdown.block_table(docs).count()


@pytest.mark.parametrize("call", ["markdown_blocks(1)", "markdown_blocks()", "markdown_parents('a', 'b', 'c', 0)", "markdown_children('a', 'b')"])
def test_wrong_arguments_fail_when_planned(spark, docs, call):
    with pytest.raises(Exception, match="argument|limit|takes"):
        spark.sql(f"SELECT * FROM {call}")


def test_scalars(spark, docs):
    got = spark.sql("SELECT document_id, chunk_tokens(text) AS a, budget_tokens(text) AS b, fold_text(text) AS c, heading_anchor(document_name) AS d FROM sql_docs")
    want = docs.select("document_id", T.chunk_tokens(F.col("text")).alias("a"), T.budget_tokens(F.col("text")).alias("b"), T.fold(F.col("text")).alias("c"), T.anchor(F.col("document_name")).alias("d"))
    assert rows(got) == rows(want)
    assert spark.sql("SELECT fused_score(0.5D, 9L, false), fused_score(0.5D, 9L, true)").first()[:] == (0.625, 0.5)
    v = [[1.0, 2.0], [0.0, 0.0], [], [1.0], None]
    pairs = spark.createDataFrame([(a, b) for a in v for b in v], "a array<double>, b array<double>")
    pairs.createOrReplaceTempView("sql_pairs")
    assert rows(spark.sql("SELECT cosine_score(a, b) AS s FROM sql_pairs")) == rows(pairs.select(vectors.cosine(F.col("a"), F.col("b")).alias("s")))
    spark.catalog.dropTempView("sql_pairs")
