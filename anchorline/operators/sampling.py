"""Seeded, order-independent choices of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.hashing import seeded_digest, uniform


def eligible_entities(cohort: DataFrame, cutoff: str | None = None, entity: str = "patient_id") -> DataFrame:
    """Entities with at least one anchor, optionally one at or after a cutoff."""
    if cutoff is not None:
        cohort = cohort.filter(F.col("stop") >= F.lit(cutoff).cast("timestamp"))
    return cohort.select(entity).distinct()


def sample_entities(entities: DataFrame, count: int, seed: int) -> DataFrame:
    """``count`` entities without replacement, all of them when there are fewer.

    The draw depends on the seed and the ids only, so any row order or partitioning gives it.
    """
    column = entities.columns[0]
    return (
        entities.withColumn("_d", seeded_digest(seed, F.col(column))).orderBy("_d", column).limit(count).drop("_d")
    )


def is_holdout(entity: Column, fraction: float, seed: int) -> Column:
    """Entity-grouped split: every row of an entity lands on one side."""
    return uniform(seed, entity) < F.lit(float(fraction))
