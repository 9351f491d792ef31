"""Features of a chosen set of discharges: the batch rules, narrowed to a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorline.operators.joins import missing_rows
from anchorline.plans.cohort import build_cohort
from anchorline.plans.features import build_features


def serving_features(frames: dict[str, DataFrame], encounter_ids: DataFrame) -> DataFrame:
    """Feature rows of the admitted discharges among the given encounter ids.

    Open stays and stays the cohort rules exclude give no row. Only rows of the patients
    concerned enter the timeline.
    """
    ids = encounter_ids.select(F.col(encounter_ids.columns[0]).alias("id")).distinct()
    chosen = frames["encounters"].join(ids, "id", "left_semi")
    touched = chosen.select("patient").distinct()
    own = lambda name: frames[name].join(touched, "patient", "left_semi")
    people = frames["patients"].join(touched, F.col("id") == F.col("patient"), "left_semi")
    return build_features(build_cohort(chosen, people), own("encounters"), own("medications"), own("conditions"))


def unservable(frames: dict[str, DataFrame], encounter_ids: DataFrame) -> DataFrame:
    """Ids that cannot be answered, and why: not in the history, or without demographics."""
    ids = encounter_ids.select(F.col(encounter_ids.columns[0]).alias("id")).distinct()
    unknown = missing_rows(ids, frames["encounters"], ["id"]).select("id", F.lit("unknown_encounter").alias("reason"))
    closed = frames["encounters"].filter("stop IS NOT NULL").join(ids, "id", "left_semi").select("id", "patient")
    people = frames["patients"].select(F.col("id").alias("patient"))
    orphan = missing_rows(closed, people, ["patient"]).select("id", F.lit("unknown_patient").alias("reason"))
    return unknown.unionByName(orphan)
