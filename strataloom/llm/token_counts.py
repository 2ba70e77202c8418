"""Operator 6, token counts: an exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm import shared
from strataloom.llm.tokens import encoder


def lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens) of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        for batch in batches:
            for piece in shared.slices(batch):
                _, at = e.encode(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(at))], ["doc_id", "n_tokens"])

    return shared.text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """One row for each encoded length that occurs:

    n_tokens; n_docs of that length; docs_at_least and tokens_at_least, over documents of that length or more;
    truncated_tokens, the corpus's ids if each document is cut to n_tokens; share_at_most, the share of documents
    of that length or less, so the q-quantile is the least n_tokens with share_at_most >= q.
    """
    with shared.Tables() as t:
        # one row a length that occurs: small, and each document is encoded once
        h = t.store(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
        # bands of consecutive lengths, about equally many each; as many bands as a shuffle has partitions
        bands = int(h.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        h = h.withColumn("mass", F.col("n_docs") * F.col("n_tokens")).repartitionByRange(bands, "n_tokens").withColumn("band", F.spark_partition_id())
        h = t.store(h, "bands")
        above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy()
        sums = h.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("mass").alias("t"))
        sums = sums.select(
            F.col("band").alias("b"), (F.sum("d").over(above) - F.col("d")).alias("docs_above"), (F.sum("t").over(above) - F.col("t")).alias("mass_above"),
            F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_mass"),
        )
        inside = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
        h = h.withColumn("docs_inside", F.sum("n_docs").over(inside)).withColumn("mass_inside", F.sum("mass").over(inside))
        h = h.join(F.broadcast(sums), F.col("band") == F.col("b"))  # one row a band
        docs, mass = F.col("docs_inside") + F.col("docs_above"), F.col("mass_inside") + F.col("mass_above")
        h = h.select(
            "n_tokens", "n_docs", docs.alias("docs_at_least"), mass.alias("tokens_at_least"),
            (F.col("all_mass") - mass + docs * F.col("n_tokens")).alias("truncated_tokens"),
            ((F.col("all_docs") - docs + F.col("n_docs")) / F.col("all_docs")).alias("share_at_most"),
        )
        return t.result(h, "token-histogram")


def token_histogram(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The histogram of ``docs``, stored; needs ``doc_id`` and ``text``. Null and empty texts have length 0; repeated
    rows count each time; an empty table gives no rows."""
    return histogram(lengths(docs, tokenizer_path))


def at_limits(counted: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_at_least, tokens_at_least, truncated_tokens) of a histogram for any limits, also where no document
    has that length: of the suffix sums, those of the next length that occurs hold; beyond the longest they are 0.

    One aggregation with a slot for each limit."""
    if any(x < 0 for x in limits):
        raise ValueError("limits must not be negative")
    wanted = sorted(set(limits))
    sums = F.struct("docs_at_least", "tokens_at_least")
    slots = [F.min_by(sums, F.when(F.col("n_tokens") >= x, F.col("n_tokens"))).alias(f"s{k}") for k, x in enumerate(wanted)]
    one = counted.agg(F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("all_tokens"), *slots)

    def row(k: int, x: int):
        docs, mass = (F.coalesce(F.col(f"s{k}.{c}"), F.lit(0)).cast("long") for c in ("docs_at_least", "tokens_at_least"))
        return F.struct(F.lit(x).cast("long").alias("limit"), docs.alias("docs_at_least"), mass.alias("tokens_at_least"), (F.col("all_tokens") - mass + docs * x).alias("truncated_tokens"))

    return one.select(F.inline(F.array(*[row(k, x) for k, x in enumerate(wanted)])))


def at_quantiles(counted: DataFrame, quantiles: list[float]) -> DataFrame:
    """(quantile, n_tokens) of a histogram: the least length with that share of documents at most; null without documents."""
    if any(not 0 <= x <= 1 for x in quantiles):
        raise ValueError("quantiles lie between 0 and 1")
    wanted = sorted({float(x) for x in quantiles})
    one = counted.agg(*[F.min(F.when(F.col("share_at_most") >= x, F.col("n_tokens"))).alias(f"s{k}") for k, x in enumerate(wanted)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("quantile"), F.col(f"s{k}").alias("n_tokens")) for k, x in enumerate(wanted)])))
