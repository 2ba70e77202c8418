"""Vector expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision, from the first element on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, empty or zero, or where the lengths differ."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def cosine_to(a: Column, vector: list[float]) -> Column:
    """``cosine`` with a vector that is known when the query is planned: its length is a constant."""
    length = sum(float(x) * float(x) for x in vector) ** 0.5
    if not length:
        return F.lit(None).cast("double")
    return F.when(F.size(a) == len(vector), dot(a, literal(vector)) / F.nullif(norm(a) * F.lit(length), F.lit(0.0)))


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector]).cast("array<double>")


def hash_embedding(text: Column, dimensions: int) -> Column:
    """A deterministic unit vector from a text's SHA-256: its bytes in turn, from -1 to 1. For tests without a model."""
    digest = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1)
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / length)


def passage_prompt(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("none")), F.lit(" | text: "), text)


def query_prompt(text: Column) -> Column:
    return F.concat(F.lit("task: search result | query: "), text)
