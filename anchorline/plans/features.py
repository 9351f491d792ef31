"""As-of features of scoring anchors, computed in a single timeline per patient."""

from __future__ import annotations

from pyspark.sql import DataFrame

from anchorline.contracts import FLAG_CODES, FLAGS, GAP_CAP_DAYS, WINDOW_DAYS
from anchorline.functions.scalar import DAY
from anchorline.operators.timeline import Lookup, Measure, as_of, interval_edges

MEASURES = [
    Measure("inpatient"),
    Measure("emergency"),
    Measure("last_inpatient", "max"),
    Measure("medications"),
    Measure("disorders"),
    Measure("history", "bits"),
]
LOOKUPS = [
    Lookup("inpatient_now", "inpatient"),
    Lookup("inpatient_floor", "inpatient", -WINDOW_DAYS * DAY),
    Lookup("emergency_now", "emergency"),
    Lookup("emergency_floor", "emergency", -WINDOW_DAYS * DAY),
    Lookup("prev_stop", "last_inpatient"),
    Lookup("active_medications", "medications", inclusive=True),
    Lookup("active_disorders", "disorders", inclusive=True),
    Lookup("flags", "history", inclusive=True),
]


def history_bits() -> str:
    """SQL of one bit per comorbidity flag that a condition row sets."""
    bits = []
    for i, (flag, codes) in enumerate(FLAG_CODES.items()):
        sets = f"code IN ({', '.join(repr(c) for c in codes)})"
        if flag == "flag_malignancy":
            sets = f"({sets} OR (system = 'ICD10' AND startswith(code, 'C')))"
        bits.append(f"if({sets}, {1 << i}L, 0L)")
    return " + ".join(bits)


def stay_events(encounters: DataFrame, *, admissions: bool = False) -> DataFrame:
    """Ended inpatient and emergency stays, dated by their stop.

    ``admissions`` adds the start of every inpatient stay, open ones included, in the same pass.
    """
    inpatient = "encounter_class = 'inpatient'"
    ended = (
        f"struct(unix_micros(stop) AS at, int({inpatient}) AS inpatient, int(NOT {inpatient}) AS emergency, "
        f"if({inpatient}, unix_micros(stop), NULL) AS last_inpatient, 0 AS admissions)"
    )
    began = (
        f"struct(if({inpatient}, unix_micros(start), NULL) AS at, 0 AS inpatient, 0 AS emergency, "
        "CAST(NULL AS BIGINT) AS last_inpatient, 1 AS admissions)"
    )
    names = ["inpatient", "emergency", "last_inpatient", *(["admissions"] if admissions else [])]
    return (
        encounters.filter("encounter_class IN ('inpatient', 'emergency')")
        .selectExpr("patient", f"explode(array({', '.join([ended, began] if admissions else [ended])})) AS e")
        .filter("e.at IS NOT NULL")
        .selectExpr("patient", "e.at AS at", *[f"e.{n} AS {n}" for n in names])
    )


def feature_events(
    encounters: DataFrame, medications: DataFrame, conditions: DataFrame, *, admissions: bool = False
) -> DataFrame:
    """Everything a feature reads, as dated weights of one patient.

    A condition date stands for its midnight: an instant of that day is at or after it, and a
    date compares with the anchor's date exactly as its midnight compares with the anchor.
    """
    stays = stay_events(encounters, admissions=admissions)
    courses = interval_edges(
        medications.selectExpr("patient", "unix_micros(start) AS start", "unix_micros(stop) AS stop"),
        "patient", "start", "stop", "at", "medications",
    )
    # One pass over the conditions: both edges of an active disorder, and the start of any flag.
    edges = (
        "array(struct(start AS at, int(live) AS w, bits AS b), "
        "struct(if(live, stop, NULL) AS at, -1 AS w, 0L AS b))"
    )
    diagnoses = (
        conditions.selectExpr(
            "patient",
            "unix_micros(timestamp(start)) AS start",
            "unix_micros(timestamp(stop)) AS stop",
            "endswith(description, '(disorder)') AND (stop IS NULL OR stop > start) AS live",
            f"{history_bits()} AS bits",
        )
        .filter("live OR bits != 0")
        .selectExpr("patient", f"explode({edges}) AS e")
        .filter("e.at IS NOT NULL")
        .selectExpr("patient", "e.at AS at", "e.w AS disorders", "e.b AS history")
    )
    return stays.unionByName(courses, allowMissingColumns=True).unionByName(diagnoses, allowMissingColumns=True)


def anchor_rows(cohort: DataFrame) -> DataFrame:
    return cohort.selectExpr(
        "encounter_id", "patient_id AS patient", "start", "stop", "unix_micros(stop) AS at", "age_at_discharge"
    )


def feature_columns() -> list[str]:
    """SQL of the feature frame's columns over the looked-up totals."""
    gap = f"(unix_micros(start) - prev_stop) / {float(DAY)!r}D"
    return [
        "encounter_id",
        "patient AS patient_id",
        "int(age_at_discharge) AS age_at_discharge",
        f"(unix_micros(stop) - unix_micros(start)) / {float(DAY)!r}D AS los_days",
        "int(inpatient_now - inpatient_floor) AS prior_inpatient_180d",
        f"coalesce(greatest(0.0D, least({float(GAP_CAP_DAYS)!r}D, {gap})), {float(GAP_CAP_DAYS)!r}D)"
        " AS days_since_prev_discharge",
        "int(emergency_now - emergency_floor) AS prior_ed_180d",
        "int(active_medications) AS active_medication_count",
        "int(active_disorders) AS active_disorder_count",
        *[f"int(flags & {1 << i}L != 0) AS {flag}" for i, flag in enumerate(FLAGS)],
    ]


def build_features(
    cohort: DataFrame, encounters: DataFrame, medications: DataFrame, conditions: DataFrame
) -> DataFrame:
    """Two ids and 14 model inputs for every cohort row, as of its discharge instant."""
    found = as_of(
        anchor_rows(cohort), feature_events(encounters, medications, conditions),
        entity="patient", at="at", measures=MEASURES, lookups=LOOKUPS,
    )
    return found.selectExpr(*feature_columns())
