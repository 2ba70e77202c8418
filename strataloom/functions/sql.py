"""The engine's functions in SQL: table functions for LATERAL use, and scalar functions.

    sql.register(spark)
    SELECT d.document_id, c.* FROM docs d, LATERAL markdown_children(d.document_id, d.document_name, d.text) c
    SELECT * FROM docs WHERE contains(fold_text(title), fold_text('Índice'))

Table functions are Python UDTFs that take Arrow batches; their ``analyze`` checks arguments when the query is planned.
Token counts and scores are SQL functions that Catalyst inlines, so they stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from strataloom import importable
from strataloom.functions import text as T
from strataloom.operators import markdown

_BLOCKS = "block int, kind string, content string, tokens int, level int, title string"
_PARENTS = "parent_id string, parent_index int, header_path string, content string, token_count int, part int, total_parts int"
_CHILDREN = "parent_id string, child_id string, chunk_index int, header_path string, content string"


def _strings(name: str, schema: str, arguments: tuple[AnalyzeArgument, ...], want: int, numbers: int = 0) -> AnalyzeResult:
    """The table's columns, once the arguments are known to be ``want`` strings and at most ``numbers`` constant limits."""
    if not want <= len(arguments) <= want + numbers:
        raise ValueError(f"{name} takes {want} to {want + numbers} arguments")
    for k, a in enumerate(arguments):
        if k < want and not isinstance(a.dataType, StringType):
            raise ValueError(f"{name}: argument {k + 1} must be a string")
        if k >= want and (not a.isConstantExpression or a.value is None or a.value < 1):
            raise ValueError(f"{name}: a limit must be a constant from 1")
    fields = (x.split() for x in schema.split(", "))
    return AnalyzeResult(StructType([StructField(name, IntegerType() if kind == "int" else StringType()) for name, kind in fields]))


class MarkdownBlocks:
    """markdown_blocks(text): the blocks of a text in order. A null text has none."""

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        return _strings("markdown_blocks", _BLOCKS, arguments, 1)

    def eval(self, text: str) -> Iterator[tuple]:
        for i, b in enumerate(markdown.blocks(text or "", markdown.Limits())):
            yield i, b.kind, b.content, b.tokens, b.level or None, b.title if b.level else None


class MarkdownParents:
    """markdown_parents(document_id, document_name, text[, parent_tokens]): the parent chunks of a text in order."""

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        return _strings("markdown_parents", _PARENTS, arguments, 3, 1)

    def eval(self, document_id: str, document_name: str, text: str, parent_tokens: int | None = None) -> Iterator[tuple]:
        limits = markdown.Limits(parent_tokens=parent_tokens) if parent_tokens else markdown.Limits()
        for p in markdown.parents(document_name, markdown.blocks(text or "", limits), limits):
            yield f"{document_id}-p{p.index}", p.index, p.header_path, p.content, p.tokens, p.part, p.total_parts


class MarkdownChildren:
    """markdown_children(document_id, document_name, text[, parent_tokens[, child_tokens]]): the child chunks in order."""

    @staticmethod
    def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
        return _strings("markdown_children", _CHILDREN, arguments, 3, 2)

    def eval(self, document_id: str, document_name: str, text: str, parent_tokens: int | None = None, child_tokens: int | None = None) -> Iterator[tuple]:
        given = {"parent_tokens": parent_tokens, "child_tokens": child_tokens}
        limits, n = markdown.Limits(**{k: v for k, v in given.items() if v}), 0
        for p in markdown.parents(document_name, markdown.blocks(text or "", limits), limits):
            for k, c in enumerate(markdown.children(p.content, limits), 1):
                yield f"{document_id}-p{p.index}", f"{document_id}-p{p.index}-c{k}", n, p.header_path, c
                n += 1


TABLES = {"markdown_blocks": MarkdownBlocks, "markdown_parents": MarkdownParents, "markdown_children": MarkdownChildren}
#: Scalar functions with their SQL, the same rules as in ``functions.text`` and ``functions.vectors``.
SCALARS = {
    "chunk_tokens(t STRING) RETURNS INT": f"CASE WHEN t = '' THEN 0 ELSE greatest(1, CAST(floor(length(t) / {T.CHUNK_CHARS}) AS INT)) END",
    "budget_tokens(t STRING) RETURNS INT": f"CASE WHEN coalesce(length(t), 0) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(t) / CAST({T.BUDGET_CHARS} AS DOUBLE)) AS INT)) END",
    "fused_score(base DOUBLE, shared BIGINT, is_seed BOOLEAN) RETURNS DOUBLE": "CASE WHEN is_seed THEN base ELSE base * (1 + least(shared, 5) * CAST(0.05 AS DOUBLE)) END",
    "cosine_score(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "CASE WHEN size(a) = size(b) AND size(a) > 0 THEN aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x) / "
        "nullif(sqrt(aggregate(a, CAST(0 AS DOUBLE), (s, x) -> s + x * x)) * sqrt(aggregate(b, CAST(0 AS DOUBLE), (s, x) -> s + x * x)), CAST(0 AS DOUBLE)) END"
    ),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session under their names; a second time changes nothing."""
    importable(spark)
    for name, kind in TABLES.items():
        spark.udtf.register(name, udtf(kind, useArrow=True))
    each = lambda f: pandas_udf(lambda s: s.map(f, na_action="ignore"), StringType())
    spark.udf.register("fold_text", each(T.fold_text))
    spark.udf.register("heading_anchor", each(T.anchor_text))
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
