"""Labelled rows for the classifiers: a bounded sample, and folds that the learner never sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm import shared


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text leaves the remainder. A null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents outside the held-out fold, chosen by a hash of doc_id.

    Labels other than 0 and 1 are ignored; of a doc_id's several labels the greater holds, of its texts the least.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    y = y.filter(~held_out(F.col("doc_id"), modulus, remainder)).groupBy("doc_id").agg(F.max("y").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = shared.text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    # at most ``most`` rows of two numbers
    return texts.join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def within_bytes(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """The rows of a bounded sample, in the order of a hash of doc_id, as far as their sizes come to ``most`` bytes."""
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # one window over the sample's numbers
    kept = rows.select("doc_id", F.sum(size).over(order).alias("bytes")).filter(F.col("bytes") <= most).select("doc_id")
    return rows.join(F.broadcast(kept), "doc_id", "left_semi")
