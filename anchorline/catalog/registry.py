"""Named queries over the given tables, each with an independent SQL statement where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = VIEWS.rstrip() + "\n" + sql
        return fn

    return register


# The adapter views of anchorline.sources.testdata, written for DuckDB.
VIEWS = """
WITH patients AS (
  SELECT c_custkey AS id,
         DATE '1925-01-01' + CAST(c_custkey * 7919 % 32000 AS INTEGER) AS birthdate,
         CASE WHEN c_custkey % 9 = 0 THEN DATE '1996-01-01' + CAST(c_custkey * 31 % 2000 AS INTEGER) END AS deathdate,
         CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender
  FROM customer),
encounters AS (
  SELECT id, patient, start, CASE WHEN id % 97 <> 0 THEN start + to_days(CAST(1 + id % 14 AS INTEGER)) END AS stop,
         CASE priority WHEN '1' THEN 'emergency' WHEN '2' THEN 'inpatient' WHEN '3' THEN 'inpatient'
                       WHEN '4' THEN 'urgentcare' ELSE 'wellness' END AS encounter_class
  FROM (SELECT o_orderkey AS id, o_custkey AS patient, left(o_orderpriority, 1) AS priority,
               o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS start FROM orders)),
medications AS (
  SELECT o_custkey AS patient, l_orderkey AS encounter, l_partkey AS code, l_shipdate AS start,
         CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN NULL
              ELSE l_shipdate + to_days(CAST(l_quantity - 3 AS INTEGER)) END AS stop
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
conditions AS (
  SELECT o_custkey AS patient, l_orderkey AS encounter, CAST(l_shipdate AS DATE) AS start,
         CASE WHEN l_linestatus = 'O' THEN NULL
              ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity * 10 AS INTEGER) END AS stop,
         CASE WHEN l_partkey % 20 = 0 THEN 'ICD10' ELSE 'SNOMED-CT' END AS system,
         CASE WHEN l_partkey % 40 = 0 THEN 'C50.9' WHEN l_partkey % 20 = 0 THEN 'J20.9'
              ELSE list_extract(['88805009','84114007','87433001','26929004','44054006','254837009','22298006',
                                 '399211009','431855005','444814009','10509002','160903007'],
                                CAST(1 + l_partkey % 12 AS INTEGER)) END AS code,
         'Record ' || l_partkey || CASE l_partkey % 3 WHEN 0 THEN ' (disorder)' WHEN 1 THEN ' (finding)'
                                                      ELSE ' (situation)' END AS description
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
classified AS (
  SELECT e.*, p.birthdate, p.deathdate, p.gender,
         year(e.stop) - year(p.birthdate)
           - CASE WHEN month(e.stop) * 100 + day(e.stop) < month(p.birthdate) * 100 + day(p.birthdate)
                  THEN 1 ELSE 0 END AS age,
         CASE WHEN encounter_class <> 'inpatient' THEN 'non_inpatient'
              WHEN e.stop IS NULL THEN 'open_stay'
              WHEN deathdate < CAST(e.start AS DATE) THEN 'death_before_admission'
              WHEN deathdate <= CAST(e.stop AS DATE) THEN 'in_hospital_death'
              WHEN year(e.stop) - year(p.birthdate)
                   - CASE WHEN month(e.stop) * 100 + day(e.stop) < month(p.birthdate) * 100 + day(p.birthdate)
                          THEN 1 ELSE 0 END < 18 THEN 'under_18' END AS reason
  FROM encounters e LEFT JOIN patients p ON p.id = e.patient),
cohort AS (
  SELECT id AS encounter_id, patient AS patient_id, start, stop, CAST(age AS INTEGER) AS age_at_discharge
  FROM classified WHERE reason IS NULL),
priors AS (
  SELECT c.encounter_id,
         count(*) FILTER (WHERE e.encounter_class = 'inpatient' AND e.stop >= c.stop - to_days(180)) AS inp,
         count(*) FILTER (WHERE e.encounter_class = 'emergency' AND e.stop >= c.stop - to_days(180)) AS ed,
         max(e.stop) FILTER (WHERE e.encounter_class = 'inpatient') AS prev
  FROM cohort c JOIN encounters e ON e.patient = c.patient_id AND e.stop < c.stop AND e.id <> c.encounter_id
  GROUP BY 1),
courses AS (
  SELECT c.encounter_id, count(*) AS n
  FROM cohort c JOIN medications m ON m.patient = c.patient_id AND m.start <= c.stop
       AND (m.stop IS NULL OR m.stop > c.stop)
  GROUP BY 1),
history AS (
  SELECT c.encounter_id,
         count(*) FILTER (WHERE (d.stop IS NULL OR d.stop > CAST(c.stop AS DATE))
                            AND d.description LIKE '%(disorder)') AS disorders,
         max(CASE WHEN code IN ('88805009','84114007') THEN 1 ELSE 0 END) AS flag_chf,
         max(CASE WHEN code IN ('233678006','87433001','185086009','195967001') THEN 1 ELSE 0 END)
           AS flag_chronic_pulmonary,
         max(CASE WHEN code IN ('26929004','230265002') THEN 1 ELSE 0 END) AS flag_dementia,
         max(CASE WHEN code IN ('44054006','127013003') THEN 1 ELSE 0 END) AS flag_diabetes,
         max(CASE WHEN code = '254837009' OR (system = 'ICD10' AND code LIKE 'C%') THEN 1 ELSE 0 END)
           AS flag_malignancy,
         max(CASE WHEN code IN ('22298006','399211009') THEN 1 ELSE 0 END) AS flag_mi,
         max(CASE WHEN code IN ('431855005','431856006') THEN 1 ELSE 0 END) AS flag_renal_disease
  FROM cohort c JOIN conditions d ON d.patient = c.patient_id AND d.start <= CAST(c.stop AS DATE)
  GROUP BY 1),
features AS (
  SELECT c.encounter_id, c.patient_id, c.age_at_discharge,
         (epoch(c.stop) - epoch(c.start)) / 86400.0 AS los_days,
         CAST(coalesce(p.inp, 0) AS INTEGER) AS prior_inpatient_180d,
         coalesce(greatest(0.0, least(365.0, (epoch(c.start) - epoch(p.prev)) / 86400.0)), 365.0)
           AS days_since_prev_discharge,
         CAST(coalesce(p.ed, 0) AS INTEGER) AS prior_ed_180d,
         CAST(coalesce(m.n, 0) AS INTEGER) AS active_medication_count,
         CAST(coalesce(h.disorders, 0) AS INTEGER) AS active_disorder_count,
         CAST(coalesce(flag_chf, 0) AS INTEGER) AS flag_chf,
         CAST(coalesce(flag_chronic_pulmonary, 0) AS INTEGER) AS flag_chronic_pulmonary,
         CAST(coalesce(flag_dementia, 0) AS INTEGER) AS flag_dementia,
         CAST(coalesce(flag_diabetes, 0) AS INTEGER) AS flag_diabetes,
         CAST(coalesce(flag_malignancy, 0) AS INTEGER) AS flag_malignancy,
         CAST(coalesce(flag_mi, 0) AS INTEGER) AS flag_mi,
         CAST(coalesce(flag_renal_disease, 0) AS INTEGER) AS flag_renal_disease
  FROM cohort c LEFT JOIN priors p USING (encounter_id) LEFT JOIN courses m USING (encounter_id)
       LEFT JOIN history h USING (encounter_id)),
labelled AS (
  SELECT c.encounter_id,
         CAST(EXISTS (SELECT 1 FROM encounters r WHERE r.patient = c.patient_id AND r.encounter_class = 'inpatient'
                        AND r.id <> c.encounter_id AND r.start > c.stop
                        AND r.start <= c.stop + to_days(30)) AS INTEGER) AS label
  FROM cohort c),
scored AS (
  SELECT f.*, c.start, c.stop, l.label,
         round(1.0 / (1.0 + exp(-round(-2.6 + 0.35 * prior_inpatient_180d + 0.2 * prior_ed_180d
               + 0.012 * (age_at_discharge - 60) + 0.03 * los_days + 0.04 * active_medication_count
               + 0.03 * active_disorder_count - 0.0015 * days_since_prev_discharge + 0.25 * flag_chf
               + 0.1 * flag_diabetes, 9))), 9) AS score
  FROM features f JOIN (SELECT encounter_id, start, stop FROM cohort) c USING (encounter_id)
       JOIN labelled l USING (encounter_id))
"""

# The stand-in score of the catalog, a logistic expression over the features.
SCORE_SQL = """
round(1.0D / (1.0D + exp(-round(-2.6D + 0.35D * prior_inpatient_180d + 0.2D * prior_ed_180d
 + 0.012D * (age_at_discharge - 60) + 0.03D * los_days + 0.04D * active_medication_count
 + 0.03D * active_disorder_count - 0.0015D * days_since_prev_discharge + 0.25D * flag_chf
 + 0.1D * flag_diabetes, 9))), 9)
"""

UNIFORM = "CAST(CAST('0x' || left(sha256({0}), 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"


def holdout_sql(entity: str = "patient_id", seed: int = 20260101, fraction: float = 0.2) -> str:
    return UNIFORM.format(f"'{seed}/' || {entity}") + f" < {fraction}"
