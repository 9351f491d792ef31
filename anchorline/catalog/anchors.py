"""Cohort rules, scalar rules, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalog import common
from anchorline.catalog.registry import UNIFORM, holdout_sql, query
from anchorline.contracts import EXCLUSION_REASONS, LABEL_WINDOW_DAYS, SPLIT_SEED
from anchorline.functions.hashing import payload_hash, rekey
from anchorline.functions.scalar import approximate_age, calendar_age, due_at, elapsed_days, iso
from anchorline.operators.joins import checked_lookup, duplicate_keys, missing_rows, restrict_to_entities, set_difference
from anchorline.operators.metrics import score_summary
from anchorline.operators.sampling import eligible_entities, is_holdout, sample_entities
from anchorline.plans.cohort import UNKNOWN_PATIENT, classify_encounters, exclusion_counts, with_cutoff
from anchorline.plans.labels import label_schedule, schedule_of
from anchorline.plans.sanity import crude_readmission_rate, population_stats
from anchorline.sources import testdata

CUTOFF = "1999-01-01"
ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"


@query("class_filter", """
SELECT encounter_class, count(*) AS encounters, count(*) FILTER (WHERE encounter_class = 'inpatient') AS inpatient
FROM encounters GROUP BY 1""")
def class_filter(spark, d):
    return testdata.encounters(spark, d).groupBy("encounter_class").agg(
        F.count("*").alias("encounters"), F.count_if(F.col("encounter_class") == "inpatient").alias("inpatient")
    )


@query("cohort_rules", "SELECT id, age, coalesce(reason, 'admitted') AS outcome FROM "
       "(SELECT id, CAST(age AS INTEGER) AS age, reason FROM classified)")
def cohort_rules(spark, d):
    f = common.frames(spark, d)
    return classify_encounters(f["encounters"], f["patients"]).select(
        "id", F.col("age_at_discharge").alias("age"), F.coalesce("exclusion_reason", F.lit("admitted")).alias("outcome")
    )


@query("exclusion_counts", "SELECT exclusion_reason, count(c.id) AS encounters FROM (SELECT unnest(["
       + ", ".join(f"'{r}'" for r in (*EXCLUSION_REASONS, UNKNOWN_PATIENT)) + "]) AS exclusion_reason) "
       "LEFT JOIN classified c ON c.reason = exclusion_reason GROUP BY 1")
def exclusions(spark, d):
    f = common.frames(spark, d)
    return exclusion_counts(f["encounters"], f["patients"])


@query("cohort", f"SELECT encounter_id, patient_id, {ISO.format('start')} AS start, {ISO.format('stop')} AS stop, "
       "age_at_discharge FROM cohort")
def cohort(spark, d):
    return common.cohort(spark, d).withColumns({"start": iso("start"), "stop": iso("stop")})


@query("cutoff_split", f"""
SELECT stop >= TIMESTAMP '{CUTOFF}' AS held_out, count(*) AS discharges, count(DISTINCT patient_id) AS patients
FROM cohort GROUP BY 1""")
def cutoff_split(spark, d):
    return with_cutoff(common.cohort(spark, d), CUTOFF).groupBy("held_out").agg(
        F.count("*").alias("discharges"), F.countDistinct("patient_id").alias("patients")
    )


@query("calendar_age", """
SELECT e.id, CAST(date_diff('year', p.birthdate, CAST(e.start AS DATE))
       - CASE WHEN strftime(e.start, '%m%d') < strftime(p.birthdate, '%m%d') THEN 1 ELSE 0 END AS INTEGER) AS age
FROM encounters e JOIN patients p ON p.id = e.patient""")
def ages(spark, d):
    f = common.frames(spark, d)
    people = f["patients"].selectExpr("id AS patient", "birthdate")
    return checked_lookup(f["encounters"], people, ["patient"]).select("id", calendar_age("birthdate", "start").alias("age"))


@query("los_days", "SELECT id, (epoch(stop) - epoch(start)) / 86400.0 AS los_days FROM encounters WHERE stop IS NOT NULL")
def los(spark, d):
    return testdata.encounters(spark, d).filter("stop IS NOT NULL").select("id", elapsed_days("start", "stop").alias("los_days"))


@query("truncate_to_date", "SELECT id, CAST(CAST(start AS DATE) AS VARCHAR) AS admitted_on FROM encounters")
def truncated(spark, d):
    return testdata.encounters(spark, d).select("id", F.to_date("start").cast("string").alias("admitted_on"))


@query("condition_arrival", f"""
SELECT patient, encounter, code, {ISO.format('CAST(start AS TIMESTAMP)')} AS arrives_at, count(*) AS n
FROM conditions GROUP BY ALL""")
def condition_arrival(spark, d):
    return testdata.conditions(spark, d).groupBy(
        "patient", "encounter", "code", iso(F.col("start").cast("timestamp")).alias("arrives_at")
    ).agg(F.count("*").alias("n"))


@query("code_tests", """
SELECT system, count(*) FILTER (WHERE description LIKE '%(disorder)') AS disorders,
       count(*) FILTER (WHERE system = 'ICD10' AND code LIKE 'C%') AS icd10_malignant,
       count(*) FILTER (WHERE code IN ('22298006', '399211009')) AS infarctions
FROM conditions GROUP BY 1""")
def code_tests(spark, d):
    return testdata.conditions(spark, d).groupBy("system").agg(
        F.count_if(F.col("description").endswith("(disorder)")).alias("disorders"),
        F.count_if((F.col("system") == "ICD10") & F.col("code").startswith("C")).alias("icd10_malignant"),
        F.count_if(F.col("code").isin("22298006", "399211009")).alias("infarctions"),
    )


EVENT_JSON = (
    "'{{\"event_type\":\"encounter\",\"payload\":{{\"ENCOUNTERCLASS\":\"' || encounter_class || '\",\"Id\":\"' || id || "
    "'\",\"PATIENT\":\"' || patient || '\",\"START\":\"' || {start} || '\",\"STOP\":\"' || coalesce({stop}, '') || '\"}}}}'"
).format(start=ISO.format("start"), stop=ISO.format("stop"))


@query("payload_hash", f"SELECT id, sha256({EVENT_JSON}) AS input_hash FROM encounters")
def hashes(spark, d):
    raw = testdata.raw_population(spark, d)["encounters"]
    return raw.select(
        F.col("Id").cast("long").alias("id"), payload_hash("encounter", {c: F.col(c) for c in raw.columns}).alias("input_hash")
    )


@query("rekey_ids", """
SELECT id, left(h, 8) || '-' || h[9:12] || '-5' || h[14:16] || '-' || h2 || h[18:20] || '-' || h[21:32] AS rekeyed
FROM (SELECT CAST(id AS VARCHAR) AS id, h, substr('89ab', CAST(CAST('0x' || h[17:17] AS INTEGER) % 4 + 1 AS INTEGER), 1) AS h2
  FROM (SELECT id, sha1(unhex('6f3c2f0e9d3b4c6a8f1e2b7a9c4d5e61') || encode('baseline/' || id)) AS h FROM encounters))""")
def rekeyed_ids(spark, d):
    raw = testdata.raw_population(spark, d)["encounters"]
    return raw.select(F.col("Id").alias("id"), rekey("baseline", F.col("Id")).alias("rekeyed"))


@query("due_instant", f"SELECT encounter_id, {ISO.format('stop + to_days(30)')} AS due_at FROM cohort")
def due_instant(spark, d):
    return common.cohort(spark, d).select("encounter_id", iso(due_at("stop", LABEL_WINDOW_DAYS)).alias("due_at"))


@query("approximate_adults", """
SELECT gender, count(*) AS patients,
       count(*) FILTER (WHERE date_diff('day', birthdate, DATE '1999-01-01') / 365.25 >= 18) AS adults
FROM patients GROUP BY 1""")
def approximate_adults(spark, d):
    adult = approximate_age("birthdate", F.lit("1999-01-01").cast("date")) >= 18
    return testdata.patients(spark, d).groupBy("gender").agg(
        F.count("*").alias("patients"), F.count_if(adult).alias("adults")
    )


@query("lookup_orphans", """
SELECT e.id, e.patient FROM encounters e
LEFT JOIN (SELECT * FROM patients WHERE id % 7 <> 3) p ON p.id = e.patient WHERE p.id IS NULL""")
def orphans(spark, d):
    f = common.frames(spark, d)
    known = f["patients"].filter("id % 7 <> 3").selectExpr("id AS patient", "birthdate")
    return checked_lookup(f["encounters"], known, ["patient"]).filter("birthdate IS NULL").select("id", "patient")


@query("lookup_duplicates", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def lookup_duplicates(spark, d):
    return duplicate_keys(testdata.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("demographics_present", """
SELECT e.id FROM encounters e ANTI JOIN (SELECT id FROM patients WHERE id % 5 <> 1) p ON p.id = e.patient
WHERE e.stop IS NOT NULL""")
def demographics_present(spark, d):
    f = common.frames(spark, d)
    known = f["patients"].filter("id % 5 <> 1").selectExpr("id AS patient")
    return missing_rows(f["encounters"].filter("stop IS NOT NULL"), known, ["patient"]).select("id")


@query("open_stays", """
SELECT encounter_class, count(*) FILTER (WHERE stop IS NULL) AS open_stays, count(*) FILTER (WHERE stop IS NOT NULL) AS closed
FROM encounters GROUP BY 1""")
def open_stays(spark, d):
    return testdata.encounters(spark, d).groupBy("encounter_class").agg(
        F.count_if(F.col("stop").isNull()).alias("open_stays"),
        F.count_if(F.col("stop").isNotNull()).alias("closed"),
    )


@query("eligible_patients", f"SELECT DISTINCT patient_id FROM cohort WHERE stop >= TIMESTAMP '{CUTOFF}'")
def eligible(spark, d):
    return eligible_entities(common.cohort(spark, d), CUTOFF)


SAMPLE = f"""chosen AS (
  SELECT patient_id FROM (SELECT DISTINCT patient_id FROM cohort WHERE stop >= TIMESTAMP '{CUTOFF}')
  ORDER BY sha256('{SPLIT_SEED}/' || patient_id), patient_id LIMIT 250)"""


@query("sample_patients", f", {SAMPLE} SELECT patient_id FROM chosen")
def sample(spark, d):
    return sample_entities(eligible_entities(common.cohort(spark, d), CUTOFF), 250, SPLIT_SEED)


@query("restrict_to_patients", f""", {SAMPLE}
SELECT 'patients' AS name, count(*) AS n FROM patients SEMI JOIN chosen ON patient_id = id
UNION ALL SELECT 'encounters', count(*) FROM encounters SEMI JOIN chosen ON patient_id = patient
UNION ALL SELECT 'medications', count(*) FROM medications SEMI JOIN chosen ON patient_id = patient
UNION ALL SELECT 'conditions', count(*) FROM conditions SEMI JOIN chosen ON patient_id = patient""")
def restricted(spark, d):
    f = common.frames(spark, d)
    chosen = sample_entities(eligible_entities(common.cohort(spark, d), CUTOFF), 250, SPLIT_SEED)
    kept = restrict_to_entities(f, chosen, {n: "id" if n == "patients" else "patient" for n in f})
    out = None
    for name, df in kept.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("grouped_split", f"""
SELECT patient_id, {holdout_sql()} AS holdout, count(*) AS discharges FROM cohort GROUP BY ALL""")
def grouped_split(spark, d):
    return common.cohort(spark, d).groupBy(
        "patient_id", is_holdout(F.col("patient_id"), 0.2, SPLIT_SEED).alias("holdout")
    ).agg(F.count("*").alias("discharges"))


@query("distinct_entities", f"""
SELECT {holdout_sql()} AS holdout, count(*) AS discharges, count(DISTINCT patient_id) AS patients,
       round(avg(label), 9) AS prevalence
FROM cohort JOIN labelled USING (encounter_id) GROUP BY 1""")
def distinct_entities(spark, d):
    return common.scored(spark, d).groupBy(is_holdout(F.col("patient_id"), 0.2, SPLIT_SEED).alias("holdout")).agg(
        F.count("*").alias("discharges"), F.countDistinct("patient_id").alias("patients"),
        F.round(F.avg("label"), 9).alias("prevalence"),
    )


@query("unscored_ids", """
SELECT encounter_id FROM cohort EXCEPT SELECT encounter_id FROM cohort WHERE encounter_id % 10 <> 4""")
def unscored_ids(spark, d):
    ids = common.cohort(spark, d).select("encounter_id")
    return set_difference(ids, ids.filter("encounter_id % 10 <> 4"))


@query("label_schedule", f"""
SELECT {ISO.format('stop + to_days(30)')} AS due_at, encounter_id, {ISO.format('stop')} AS discharged_at, label
FROM cohort JOIN labelled USING (encounter_id)""")
def schedule(spark, d):
    return label_schedule(common.frames(spark, d))


SPAN = ("1998-01-01T00:00:00Z", "1998-12-31T23:59:59Z")


@query("scheduled_within", f"""
, schedule AS (SELECT {ISO.format('stop + to_days(30)')} AS due_at, encounter_id, {ISO.format('stop')} AS discharged_at, label
FROM cohort JOIN labelled USING (encounter_id))
SELECT * FROM schedule WHERE discharged_at >= '{SPAN[0]}' AND discharged_at <= '{SPAN[1]}'""")
def within_span(spark, d):
    rows = common.scored(spark, d)
    return schedule_of(rows.select("encounter_id", "label"), rows).filter(F.col("discharged_at").between(*SPAN))


@query("due_labels", f"""
, schedule AS (SELECT {ISO.format('stop + to_days(30)')} AS due_at, encounter_id, {ISO.format('stop')} AS discharged_at, label
FROM cohort JOIN labelled USING (encounter_id))
SELECT * FROM schedule WHERE due_at > '{SPAN[0]}' AND due_at <= '{SPAN[1]}'""")
def due(spark, d):
    from anchorline.operators.order import due_between

    rows = common.scored(spark, d)
    return due_between(schedule_of(rows.select("encounter_id", "label"), rows), *SPAN)


@query("pending_labels", f"""
SELECT count(*) AS scheduled, count(*) FILTER (WHERE stop + to_days(30) <= TIMESTAMP '{CUTOFF}') AS released,
       count(*) FILTER (WHERE stop + to_days(30) > TIMESTAMP '{CUTOFF}') AS pending
FROM cohort WHERE {ISO.format('stop')} BETWEEN '{SPAN[0]}' AND '{SPAN[1]}'""")
def pending(spark, d):
    released = due_at("stop", LABEL_WINDOW_DAYS) <= F.lit(CUTOFF).cast("timestamp")
    return common.cohort(spark, d).filter(iso("stop").between(*SPAN)).agg(
        F.count("*").alias("scheduled"), F.count_if(released).alias("released"), F.count_if(~released).alias("pending")
    )


@query("population_stats", f"""
SELECT (SELECT count(*) FROM patients) AS total_patients, count(*) AS total_encounters,
       count(*) FILTER (WHERE encounter_class = 'inpatient' AND stop IS NOT NULL) AS inpatient_encounters,
       (SELECT round(avg(CASE WHEN date_diff('day', birthdate, DATE '1999-01-01') / 365.25 >= 18 THEN 1.0 ELSE 0 END), 9)
        FROM patients) AS adult_share,
       {ISO.format('min(start) FILTER (WHERE stop IS NOT NULL)')} AS first_start, {ISO.format('max(stop)')} AS last_stop,
       count(*) FILTER (WHERE stop IS NULL) AS invalid_timestamp_rows
FROM encounters""")
def sanity(spark, d):
    raw = testdata.raw_population(spark, d)
    return population_stats(raw["patients"], raw["encounters"], "1999-01-01")


@query("crude_readmission_rate", """
, stays AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY start, stop, id) AS rn FROM encounters
            WHERE encounter_class = 'inpatient' AND stop IS NOT NULL)
SELECT count(*) AS inpatient, count(*) FILTER (WHERE again) AS readmitted,
       round(count(*) FILTER (WHERE again) / count(*), 9) AS rate
FROM (SELECT s.id, bool_or(r.id IS NOT NULL) AS again FROM stays s LEFT JOIN stays r
      ON r.patient = s.patient AND r.rn > s.rn AND r.start > s.stop AND r.start <= s.stop + to_days(30) GROUP BY 1)""")
def crude_rate(spark, d):
    return crude_readmission_rate(testdata.encounters(spark, d))


@query("score_summary", """
SELECT count(*) AS count, round(avg(score), 9) AS mean, min(score) AS minimum,
       round(quantile_cont(score, 0.05), 9) AS p05, round(quantile_cont(score, 0.25), 9) AS p25,
       round(quantile_cont(score, 0.5), 9) AS p50, round(quantile_cont(score, 0.75), 9) AS p75,
       round(quantile_cont(score, 0.95), 9) AS p95, max(score) AS maximum FROM scored""")
def summary(spark, d):
    out = score_summary(common.scored(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "p05", "p25", "p50", "p75", "p95")})


@query("hash_uniform", f"SELECT id, round({UNIFORM.format(chr(39) + '7/' + chr(39) + ' || id')}, 12) AS u FROM patients")
def hash_uniform(spark, d):
    from anchorline.functions.hashing import uniform

    return testdata.patients(spark, d).select("id", F.round(uniform(7, F.col("id")), 12).alias("u"))
