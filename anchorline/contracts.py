"""Schemas, column contracts and the fixed values of the clinical pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TIMESTAMP_PATTERN = "yyyy-MM-dd'T'HH:mm:ss'Z'"
DATE_PATTERN = "yyyy-MM-dd"

COHORT_VERSION = "1.0.0"
FEATURE_VERSION = "1.1.0"
LABEL_VERSION = "1.0.0"
MODEL_NAME = "readmission-trees"

# Durations of the feature and label rules.
WINDOW_DAYS = 180
GAP_CAP_DAYS = 365
LABEL_WINDOW_DAYS = 30
LOOKBACK_DAYS = max(WINDOW_DAYS, GAP_CAP_DAYS)

# Split, gate and bootstrap parameters.
TRAINING_CUTOFF = "2025-01-01"
SPLIT_SEED = 20260101
HOLDOUT_FRACTION = 0.2
BOOTSTRAP_SEED = 20260101
BOOTSTRAP_REPLICATES = 1000
CALIBRATION_BINS = 10
SIGNAL_BAND = (0.65, 0.92)
ECE_LIMIT = 0.05
REPRODUCTION_TOLERANCE = 1e-6
SUBGROUP_MIN_ROWS = 50
AGE_BANDS = (("age_18_49", 18, 50), ("age_50_64", 50, 65), ("age_65_79", 65, 80), ("age_80_plus", 80, None))

# Condition codes that set each comorbidity flag.
FLAG_CODES: dict[str, tuple[str, ...]] = {
    "flag_chf": ("84114007", "88805009"),
    "flag_chronic_pulmonary": ("185086009", "195967001", "233678006", "87433001"),
    "flag_dementia": ("230265002", "26929004"),
    "flag_diabetes": (
        "127013003", "1501000119109", "1551000119108", "157141000119108", "368581000119106",
        "427089005", "44054006", "60951000119105", "90781000119102", "97331000119101",
    ),
    "flag_malignancy": (
        "109838007", "126906006", "254632001", "254637007", "254837009", "363406005",
        "424132000", "67811000119102", "91861009", "93143009", "93761005", "94260004", "94503003",
    ),
    "flag_mi": ("22298006", "399211009", "401303003", "401314000"),
    "flag_renal_disease": ("431855005", "431856006", "431857002", "433144002"),
}
FLAGS = tuple(FLAG_CODES)

MODEL_INPUTS = (
    "age_at_discharge",
    "los_days",
    "prior_inpatient_180d",
    "days_since_prev_discharge",
    "prior_ed_180d",
    "active_medication_count",
    "active_disorder_count",
    *FLAGS,
)
FEATURE_COLUMNS = ("encounter_id", "patient_id", *MODEL_INPUTS)
COHORT_COLUMNS = ("encounter_id", "patient_id", "start", "stop", "age_at_discharge")

# Exclusion reasons in the order the rules are applied; open stays are counted on their own.
EXCLUSION_REASONS = ("non_inpatient", "open_stay", "death_before_admission", "in_hospital_death", "under_18")


@dataclass(frozen=True)
class TableContract:
    """One raw table: the columns the pipeline reads, and how they are keyed."""

    name: str
    kind: str
    payload: tuple[str, ...]
    key: tuple[str, ...]
    entity: str
    required: tuple[str, ...]
    time_pattern: str
    required_times: tuple[str, ...]
    optional_times: tuple[str, ...]
    ordered_interval: bool
    ids: tuple[str, ...]

    @property
    def payload_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self.payload])


PATIENTS = TableContract(
    name="patients",
    kind="patient",
    payload=("Id", "BIRTHDATE", "DEATHDATE"),
    key=("Id",),
    entity="Id",
    required=("Id",),
    time_pattern=DATE_PATTERN,
    required_times=("BIRTHDATE",),
    optional_times=("DEATHDATE",),
    ordered_interval=False,
    ids=("Id",),
)
ENCOUNTERS = TableContract(
    name="encounters",
    kind="encounter",
    payload=("Id", "START", "STOP", "PATIENT", "ENCOUNTERCLASS"),
    key=("Id",),
    entity="PATIENT",
    required=("Id", "PATIENT", "ENCOUNTERCLASS"),
    time_pattern=TIMESTAMP_PATTERN,
    required_times=("START",),
    optional_times=("STOP",),
    ordered_interval=True,
    ids=("Id", "PATIENT"),
)
MEDICATIONS = TableContract(
    name="medications",
    kind="medication",
    payload=("START", "STOP", "PATIENT", "ENCOUNTER", "CODE"),
    key=("PATIENT", "ENCOUNTER", "CODE", "START", "STOP"),
    entity="PATIENT",
    required=("PATIENT", "ENCOUNTER", "CODE"),
    time_pattern=TIMESTAMP_PATTERN,
    required_times=("START",),
    optional_times=("STOP",),
    # A prescription whose STOP precedes its START is accepted and is never active.
    ordered_interval=False,
    ids=("PATIENT", "ENCOUNTER"),
)
CONDITIONS = TableContract(
    name="conditions",
    kind="condition",
    payload=("START", "STOP", "PATIENT", "ENCOUNTER", "SYSTEM", "CODE", "DESCRIPTION"),
    key=("PATIENT", "ENCOUNTER", "CODE", "START"),
    entity="PATIENT",
    required=("PATIENT", "ENCOUNTER", "SYSTEM", "CODE"),
    time_pattern=DATE_PATTERN,
    required_times=("START",),
    optional_times=("STOP",),
    ordered_interval=True,
    ids=("PATIENT", "ENCOUNTER"),
)

TABLES: dict[str, TableContract] = {t.name: t for t in (PATIENTS, ENCOUNTERS, MEDICATIONS, CONDITIONS)}
BY_KIND: dict[str, TableContract] = {t.kind: t for t in TABLES.values()}
# Order of kinds that arrive at one instant.
KIND_ORDER = {"medication": 0, "condition": 1, "encounter": 2}
