"""Driver queries of the corpus operators: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trestle.llm import (
    bpe,
    fingerprints,
    line_dedup,
    minhash,
    mixing,
    quality_gbt,
    quality_rules,
    suffix_dedup,
    token_counts,
    toxicity,
)
from trestle.llm.shared import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The id that the vocabulary leaves free.
END_OF_DOCUMENT = 50_256


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN, END_OF_DOCUMENT)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_quality_classifier, op3_quality_rules, op4_byte_bpe, op5_line_dedup, op6_toxicity,
        op7_fingerprints, op8_suffix_dedup, op9_token_counts, op10_minhash,
    )
}
ORACLES = {"op1_source_mixing": mixing.SQL, "op3_quality_rules": quality_rules.SQL, "op10_minhash": minhash.SQL}
