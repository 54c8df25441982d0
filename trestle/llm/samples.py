"""Labelled rows for training: which may be learned from, and a bounded, repeatable sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from: crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id``, ``y`` of at most ``most`` labelled documents outside the held-out third, by hash of the id.

    A document labelled more than once counts once, with its largest label; null labels are left out.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    once = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def training_texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id``, ``text``, ``y`` of the sample; its ids (``most`` rows at the very most) are broadcast.

    A document whose id repeats counts once, with its least text, so that the sample keeps its bound; null if all are.
    """
    ids = training_labels(labels, label, most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
