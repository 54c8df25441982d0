"""Corpus pipeline: quality rules, line dedup, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read back as the
next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trestle.llm import bpe, line_dedup, minhash, mixing, quality_rules
from trestle.llm.queries import vocabulary
from trestle.llm.shared import cut, forget, release, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the rules reject go."""
    return quality_rules.kept_documents(docs)


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of equal and near-equal lines the first in the corpus stays; documents left without a line go."""
    return line_dedup.deduplicated(docs, drop_emptied=True)


def near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, five words, similarity 0.8: one document of each group stays."""
    return minhash.kept_documents(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents once for each epoch in which the target weights read them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: ids, and hashes of ids and of the decoded bytes."""
    return bpe.digests(docs, vocabulary(), public_tokenizers.PATTERN)


STAGES = [("quality_rules", rules), ("line_dedup", fuzzy_lines), ("minhash_near_dedup", near_documents), ("source_mixing", mix), ("byte_bpe", encode)]

#: Fuzzy lines and BPE are not SQL; a test holds the rows of run() against a brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = cut(stage(spark, docs, sf_dir), f"pipeline-{name}"), docs
        forget(before)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
