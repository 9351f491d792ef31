"""From raw documents to token ids: the training-data operators in a row, each stage written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorline.llm import bpe, edit_join, jaccard_join, phrase_index, toxicity
from anchorline.llm.phrase_index import small_side
from anchorline.llm.queries import table, vocabulary
from anchorline.llm.store import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model rejects go. It learns from the labels of the documents at hand."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go; every document stays, maybe without text."""
    found = edit_join.dedup_lines(docs, shortest=edit_join.SHORT).select(docs.columns)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id stays of each group of near-duplicates."""
    others = jaccard_join.near_duplicates(docs).filter(F.col("class_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(small_side(stored(others, "pipeline-duplicates")), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = phrase_index.phrase_matches(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("__hits") == 0).select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.encode_documents(docs, vocabulary(), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]

# Training, edit distance, similarity joins and BPE are beyond SQL; tests compare the last four stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
