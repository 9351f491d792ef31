"""Inputs shared by the catalog's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorline.catalog.registry import SCORE_SQL
from anchorline.plans.cohort import build_cohort
from anchorline.plans.features import build_features
from anchorline.plans.labels import build_labels, build_training_rows
from anchorline.session import materialize
from anchorline.sources import testdata

_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return testdata.population(spark, sf_dir)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return build_cohort(f["encounters"], f["patients"])


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return build_features(build_cohort(f["encounters"], f["patients"]), f["encounters"], f["medications"], f["conditions"])


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return build_labels(build_cohort(f["encounters"], f["patients"]), f["encounters"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort rows with features, label and the stand-in score, computed once per session.

    Evaluation, audit and monitoring all read this table several times, so it is kept as a
    checkpoint in the shared folder.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "scored")
    if key not in _TABLES:
        rows = build_training_rows(frames(spark, sf_dir)).withColumn("score", F.expr(SCORE_SQL))
        _TABLES[key] = materialize(rows)
    return _TABLES[key]
