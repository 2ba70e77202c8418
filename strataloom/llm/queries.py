"""The queries of the operators of this subpackage, with their production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import best_fit, byte_bpe, conversations, fingerprints, near_dedup, packing, quality_fm, quality_rules, spelling, token_counts, token_files, toxicity, url_filter
from strataloom.llm.shared import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, width=2048))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.train(docs, table(spark, sf_dir, "labels"), modulus=4, remainder=2), modulus=4, remainder=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), modulus=3, remainder=1), modulus=3, remainder=1)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_histogram(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), percent=85, width=5)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.listed_of(pages), url_filter.QUERY_RULES)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), damage_every=spelling.DAMAGE_EVERY)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.digests(best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, width=1024))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_quality_rules": op2_quality_rules,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_toxicity": op4_toxicity,
        "op5_fingerprints": op5_fingerprints,
        "op6_token_counts": op6_token_counts,
        "op7_near_dedup": op7_near_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_token_files": op9_token_files,
        "op10_url_filter": op10_url_filter,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_best_fit": op13_best_fit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.oracle_sql(),
        "op7_near_dedup": near_dedup.oracle_sql(percent=85, width=5),
        "op10_url_filter": url_filter.oracle_sql(),
        "op11_conversation_repair": conversations.oracle_sql(),
        "op12_spelling_variants": spelling.oracle_sql(),
    }
