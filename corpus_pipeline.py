"""A corpus pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import near_dedup, packing, quality_fm, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from labelled documents of its training fold, doesn't reject.

    Null and empty texts are judged as texts without words; rows that repeat share their fate; columns stay as they are."""
    model = toxicity.train(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned likewise, accepts. Odd rows as in the stage before."""
    machine = quality_fm.train(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
    return quality_fm.keep(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, five-word shingles at a similarity of 0.8, the document of the least doc_id.

    Texts without words stay. Rows that share or lack a doc_id are told apart by their texts, of equal rows one stays."""
    return near_dedup.keep_one(docs, percent=80, width=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids, each with its ids; the padded sequences are ``sequences``.

    A null or empty text is its end id alone; rows that repeat are packed as documents of their own."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, width=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near-duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: SQL can express neither the classifiers nor the tokenizer; the tests hold the stages against plain code.
ORACLE_SQL = None


def kept(spark: SparkSession, sf_dir: str, tables: shared.Tables) -> DataFrame:
    """What the stages before packing keep of ``documents``, each result written as Parquet and reread; a result goes
    when the next is stored, the last one with ``tables``."""
    docs, last = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, at = shared.materialize_at(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            shared.remove(spark, last)
        last = at
    tables.made.append((spark, last))
    return docs


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to train on: the padded sequences of 2048 ids, stored, of what the stages keep."""
    with shared.Tables() as tables:
        return packing.sequences(kept(spark, sf_dir, tables), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, width=2048)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages; of the last one's pieces, digests of the ids."""
    with shared.Tables() as tables:
        return packing.digests(STAGES[-1][1](spark, kept(spark, sf_dir, tables), sf_dir))
