"""Labelled rows for fitting: which are held out, and the bounded sample a classifier sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents no classifier learns from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label of every labelled document that is not held out; of several labels the largest."""
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, longest: int) -> DataFrame:
    """At most ``limit`` labelled, not held out rows: doc_id, text, label.

    Rows are drawn by the hash of their id, so the sample does not depend on order or partitioning. Texts over
    ``longest`` characters are not used for fitting. A document with several labels counts as its largest one; null
    labels, ids and texts are left out. Only ids and labels are sorted; they are small enough to broadcast, being
    bounded by ``limit``.
    """
    chosen = training_labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").filter(F.length("text") <= longest)
    return texts.join(F.broadcast(chosen), "doc_id")
