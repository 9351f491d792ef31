"""Forward-window labels: an inpatient admission within 30 days of the discharge."""

from __future__ import annotations

from pyspark.sql import DataFrame

from anchorline.contracts import LABEL_WINDOW_DAYS
from anchorline.functions.scalar import DAY, due_at, iso
from anchorline.operators.timeline import Lookup, Measure, as_of
from anchorline.plans import features as feature_plan
from anchorline.plans.cohort import build_cohort

SPAN = LABEL_WINDOW_DAYS * DAY
MEASURES = [Measure("admissions")]
LOOKUPS = [
    Lookup("admissions_now", "admissions", inclusive=True),
    Lookup("admissions_ahead", "admissions", SPAN, inclusive=True),
]


def label_events(encounters: DataFrame) -> DataFrame:
    """Admissions of every inpatient stay, before any cohort exclusion and open stays included."""
    return encounters.filter("encounter_class = 'inpatient'").selectExpr(
        "patient", "unix_micros(start) AS at", "1 AS admissions"
    )


def label_column() -> str:
    # A stay recorded with START after STOP would otherwise count as its own readmission.
    start, stop = "unix_micros(start)", "unix_micros(stop)"
    itself = f"int({start} > {stop} AND {start} <= {stop} + {SPAN}L)"
    return f"int(admissions_ahead - admissions_now - {itself} > 0) AS label"


def build_labels(cohort: DataFrame, encounters: DataFrame) -> DataFrame:
    """encounter_id and a 0/1 label for every cohort row."""
    found = as_of(
        feature_plan.anchor_rows(cohort), label_events(encounters), entity="patient", at="at",
        measures=MEASURES, lookups=LOOKUPS,
    )
    return found.selectExpr("encounter_id", label_column())


def build_training_rows(frames: dict[str, DataFrame], cohort: DataFrame | None = None) -> DataFrame:
    """Cohort instants, features and label together: one timeline answers both plans."""
    if cohort is None:
        cohort = build_cohort(frames["encounters"], frames["patients"])
    events = feature_plan.feature_events(
        frames["encounters"], frames["medications"], frames["conditions"], admissions=True
    )
    found = as_of(
        feature_plan.anchor_rows(cohort), events, entity="patient", at="at",
        measures=feature_plan.MEASURES + MEASURES, lookups=feature_plan.LOOKUPS + LOOKUPS,
    )
    return found.selectExpr(*feature_plan.feature_columns(), "start", "stop", label_column())


def label_schedule(frames: dict[str, DataFrame]) -> DataFrame:
    """When each label may be released, earliest first."""
    return due_rows(build_training_rows(frames)).orderBy("due_at", "encounter_id")


def schedule_of(labels: DataFrame, cohort: DataFrame) -> DataFrame:
    """The same for labels that lack their stay's stop."""
    return due_rows(labels.join(cohort.select("encounter_id", "stop"), "encounter_id"))


def due_rows(labelled: DataFrame) -> DataFrame:
    return labelled.select(
        iso(due_at("stop", LABEL_WINDOW_DAYS)).alias("due_at"),
        "encounter_id",
        iso("stop").alias("discharged_at"),
        "label",
    )
