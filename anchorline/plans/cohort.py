"""Scoring anchors: adult inpatient discharges, with every exclusion counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorline.contracts import EXCLUSION_REASONS
from anchorline.functions.scalar import calendar_age
from anchorline.operators.joins import checked_lookup


# The reason of a stay whose patient is not known.
UNKNOWN_PATIENT = "unknown_patient"


def classify_encounters(encounters: DataFrame, patients: DataFrame, *, strict: bool = False) -> DataFrame:
    """Every encounter with its age at discharge and the first rule it fails, NULL if none.

    The class and open-stay rules need no demographics, so they are decided on the encounter;
    with ``strict`` an inpatient stay of an unknown patient raises.
    """
    people = patients.select(F.col("id").alias("patient"), "birthdate", "deathdate")
    joined = checked_lookup(encounters, people, ["patient"])
    return joined.withColumns(
        {"age_at_discharge": calendar_age("birthdate", "stop"), "exclusion_reason": exclusion_reason(strict)}
    ).drop("birthdate", "deathdate")


def exclusion_reason(strict: bool = False) -> F.Column:
    """The first rule an encounter with its patient's dates fails, NULL when it is admitted."""
    inpatient = F.col("encounter_class") == "inpatient"
    return (
        F.when(~inpatient, EXCLUSION_REASONS[0])
        .when(F.col("stop").isNull(), EXCLUSION_REASONS[1])
        .when(F.col("birthdate").isNull(), _unknown_patient(strict))
        .when(F.col("deathdate") < F.to_date("start"), EXCLUSION_REASONS[2])
        .when(F.col("deathdate") <= F.to_date("stop"), EXCLUSION_REASONS[3])
        .when(calendar_age("birthdate", "stop") < 18, EXCLUSION_REASONS[4])
    )


def _unknown_patient(strict: bool):
    if not strict:
        return F.lit(UNKNOWN_PATIENT)
    message = F.concat(F.lit("inpatient encounter references an unknown patient: "), F.col("id").cast("string"))
    return F.raise_error(message).cast("string")


def build_cohort(encounters: DataFrame, patients: DataFrame, *, strict: bool = False) -> DataFrame:
    """One row per admitted discharge: encounter_id, patient_id, start, stop, age_at_discharge."""
    # Only inpatient stays can be admitted, so the rest never reach the join.
    stays = encounters.filter(F.col("encounter_class") == "inpatient")
    return (
        classify_encounters(stays, patients, strict=strict)
        .filter(F.col("exclusion_reason").isNull())
        .select(
            F.col("id").alias("encounter_id"), F.col("patient").alias("patient_id"), "start", "stop",
            "age_at_discharge",
        )
    )


def exclusion_counts(encounters: DataFrame, patients: DataFrame) -> DataFrame:
    """Rows per first-failed rule, 0 for a rule that no row fails first.

    The class rule needs no demographics, so the bulk of the table is counted where it is read
    and only inpatient stays are joined.
    """
    inpatient = F.col("encounter_class") == "inpatient"
    others = encounters.filter(~inpatient).groupBy(F.lit(EXCLUSION_REASONS[0]).alias("exclusion_reason")).agg(
        F.count("*").alias("encounters")
    )
    stays = (
        classify_encounters(encounters.filter(inpatient), patients)
        .filter(F.col("exclusion_reason").isNotNull())
        .groupBy("exclusion_reason")
        .agg(F.count("*").alias("encounters"))
    )
    every = encounters.sparkSession.createDataFrame([(r,) for r in (*EXCLUSION_REASONS, UNKNOWN_PATIENT)], "exclusion_reason STRING")
    return every.join(others.unionByName(stays), "exclusion_reason", "left").withColumn("encounters", F.coalesce("encounters", F.lit(0)))


def with_cutoff(cohort: DataFrame, cutoff: str) -> DataFrame:
    """Mark each discharge as held out when it is at or after the cutoff."""
    return cohort.withColumn("held_out", F.col("stop") >= F.lit(cutoff).cast("timestamp"))


def split_at_cutoff(cohort: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Discharges strictly before the cutoff, and the exact rest."""
    marked = with_cutoff(cohort, cutoff)
    return marked.filter(~F.col("held_out")).drop("held_out"), marked.filter("held_out").drop("held_out")


def training_window(cohort: DataFrame, cutoff: str) -> DataFrame:
    return split_at_cutoff(cohort, cutoff)[0]
