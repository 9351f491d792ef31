"""Batch selection, model training and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalog import common
from anchorline.catalog.anchors import CUTOFF, SAMPLE
from anchorline.catalog.audits import LOGS, predictions
from anchorline.catalog.registry import ORACLES, query
from anchorline.contracts import SPLIT_SEED, TABLES
from anchorline.functions.hashing import rekey
from anchorline.plans import training
from anchorline.plans.cohort import build_cohort, training_window
from anchorline.plans.scoring import batch_report, select_held_out_batch
from anchorline.session import materialize, scratch_path
from anchorline.sources import testdata
from anchorline.sources.logs import EventStore, preload
from anchorline.sources.manifest import build_manifest, verify_manifest
from anchorline.sources.raw import load_population, rekeyed, typed_population


@query("held_out_batch", f""", {SAMPLE}
SELECT c.encounter_id, c.stop >= TIMESTAMP '{CUTOFF}' AS held_out FROM cohort c SEMI JOIN chosen USING (patient_id)""")
def held_out_batch(spark, d):
    return select_held_out_batch(common.frames(spark, d), cutoff=CUTOFF, count=250, seed=SPLIT_SEED).anchors.select(
        "encounter_id", "held_out"
    )


@query("batch_run_coverage", LOGS + f""", {SAMPLE},
batch AS (SELECT c.* FROM cohort c SEMI JOIN chosen USING (patient_id)),
logged AS (SELECT p.* FROM predictions p SEMI JOIN chosen USING (patient_id))
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN p.encounter_id IS NULL THEN 'unscored' WHEN b.encounter_id IS NULL THEN 'unexpected'
    WHEN b.stop >= TIMESTAMP '{CUTOFF}' THEN 'held_out' ELSE 'pre_cutoff' END AS bucket
  FROM batch b FULL JOIN logged p ON p.encounter_id = b.encounter_id) GROUP BY 1""")
def batch_run_coverage(spark, d):
    batch = select_held_out_batch(common.frames(spark, d), cutoff=CUTOFF, count=250, seed=SPLIT_SEED)
    people = batch.frames["patients"].select(F.col("id").alias("patient_id"))
    mine = predictions(spark, d).join(people, "patient_id", "left_semi")
    return batch_report(batch, mine, CUTOFF).partition.groupBy("bucket").agg(F.count("*").alias("n"))


@query("trained_model_scores")
def trained_model_scores(spark, d):
    rows = common.scored(spark, d).drop("score")
    fitted, held = training.split(rows, 0.2, SPLIT_SEED)
    model = training.fit(fitted, rounds=10, depth=4)
    return training.score(model, held).select("encounter_id", "label", F.round("score", 6).alias("score"))


def _export(spark, d):
    folder = scratch_path(spark, "export")
    for name, df in testdata.raw_population(spark, d).items():
        df.write.option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    return folder


@query("raw_text_scan", """
SELECT 'patients' AS name, count(*) AS n, count(*) FILTER (WHERE deathdate IS NULL) AS empty FROM patients
UNION ALL SELECT 'encounters', count(*), count(*) FILTER (WHERE stop IS NULL) FROM encounters
UNION ALL SELECT 'medications', count(*), count(*) FILTER (WHERE stop IS NULL) FROM medications
UNION ALL SELECT 'conditions', count(*), count(*) FILTER (WHERE stop IS NULL) FROM conditions""")
def raw_text_scan(spark, d):
    out = None
    for name, df in load_population(spark, _export(spark, d)).items():
        gap = "DEATHDATE" if name == "patients" else "STOP"
        row = df.agg(F.count("*").alias("n"), F.count_if(F.col(gap) == "").alias("empty")).select(F.lit(name).alias("name"), "n", "empty")
        out = row if out is None else out.unionByName(row)
    return out


# Cells with quotes, commas and line breaks come back as they were written.
@query("csv_cells", """
SELECT patient, encounter, code, description || chr(10) || 'said "yes", ' || code AS description, count(*) AS n FROM conditions GROUP BY ALL""")
def csv_cells(spark, d):
    folder = scratch_path(spark, "cells")
    told = F.concat("DESCRIPTION", F.lit('\nsaid "yes", '), "CODE")
    testdata.raw_population(spark, d)["conditions"].withColumn("DESCRIPTION", told).write.option("header", True).option(
        "escape", '"').csv(f"{folder}/conditions.csv")
    read = load_population(spark, folder, frames=("conditions",), line_breaks=True)["conditions"]
    return read.groupBy(
        F.col("PATIENT").cast("long").alias("patient"), F.col("ENCOUNTER").cast("long").alias("encounter"),
        F.col("CODE").alias("code"), F.col("DESCRIPTION").alias("description"),
    ).agg(F.count("*").alias("n"))


# Ids are rewritten, and nothing else.
@query("rekeyed_cohort", "SELECT encounter_id, patient_id, age_at_discharge, true AS joined FROM cohort")
def rekeyed_cohort(spark, d):
    raw = testdata.raw_population(spark, d)
    frames = typed_population(rekeyed(raw, "second"))
    new = build_cohort(frames["encounters"], frames["patients"])
    # Back to the old ids by rewriting them again, each on its own.
    old = raw["encounters"].select(
        F.col("Id").cast("long").alias("id"), F.col("PATIENT").cast("long").alias("patient"),
        rekey("second", F.col("Id")).alias("encounter_id"), rekey("second", F.col("PATIENT")).alias("_patient"),
    )
    return new.join(old, "encounter_id", "left").select(
        F.col("id").alias("encounter_id"), F.col("patient").alias("patient_id"), "age_at_discharge", (F.col("patient_id") == F.col("_patient")).alias("joined")
    )


# Documents of one file of digests at most; a language has as many files as it needs.
FILE_DOCUMENTS = 400


def _document_manifest(spark, d):
    """Text files with the documents' digests, of one language and one range of ids each, measured."""
    folder = scratch_path(spark, "manifest")
    lines = spark.read.parquet(f"{d}/documents.parquet").select(
        "lang", F.expr(f"doc_id div {FILE_DOCUMENTS}").alias("block"),
        F.concat_ws(",", F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("value"), "doc_id",
    )
    # One file a language and block, in order of the id, as SQL can repeat it.
    lines.repartition("lang", "block").sortWithinPartitions("lang", "block", "doc_id").drop("doc_id").write.partitionBy("lang", "block").text(folder)
    measured = build_manifest(spark, folder, "*.txt")
    return measured.withColumn("path", F.regexp_replace("path", "^.*lang=([a-z]+)/block=([0-9]+)/.*$", "$1/$2"))


DOCUMENT_FILES = f"""WITH files AS (SELECT lang || '/' || doc_id // {FILE_DOCUMENTS} AS path,
  string_agg(doc_id || ',' || sha256(text) || chr(10), '' ORDER BY doc_id) AS body, count(*) AS n FROM documents GROUP BY 1)
"""


@query("file_manifest")
def file_manifest(spark, d):
    return _document_manifest(spark, d)


ORACLES["file_manifest"] = DOCUMENT_FILES + """
SELECT path, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS bytes, n - 1 AS rows FROM files"""


@query("manifest_check")
def manifest_check(spark, d):
    actual = materialize(_document_manifest(spark, d))
    lang = F.split("path", "/")[0]
    expected = actual.withColumn("sha256", F.when(lang == "de", F.lit("0")).when(lang != "fr", F.col("sha256"))).withColumn(
        "path", F.when(lang == "es", F.concat(F.lit("it/"), F.split("path", "/")[1])).otherwise(F.col("path"))
    )
    return verify_manifest(expected, actual)


ORACLES["manifest_check"] = DOCUMENT_FILES + """
SELECT * FROM (SELECT path, CASE split_part(path, '/', 1) WHEN 'de' THEN 'checksum mismatch' WHEN 'fr' THEN 'unverified' WHEN 'es' THEN 'extra file' END AS problem
  FROM files UNION ALL SELECT 'it/' || split_part(path, '/', 2), 'missing file' FROM files WHERE split_part(path, '/', 1) = 'es') WHERE problem IS NOT NULL"""


# The first load brings half of the patients; the second brings everything up to a day, with altered and broken rows.
PRELOAD_CUT = "1998-01-01T00:00:00Z"


@query("preload_history", f"""
, told AS (
  SELECT 'patient' AS kind, id % 2 = 0 AS even, false AS altered, false AS broken, false AS later FROM patients
  UNION ALL SELECT 'encounter', patient % 2 = 0, id % 19 = 0, false, stop IS NULL OR stop >= TIMESTAMP '{PRELOAD_CUT[:10]}' FROM encounters
  UNION ALL SELECT 'medication', patient % 2 = 0, false, encounter % 23 = 0, start >= TIMESTAMP '{PRELOAD_CUT[:10]}' FROM medications
  UNION ALL SELECT 'condition', patient % 2 = 0, false, false, start >= DATE '{PRELOAD_CUT[:10]}'
    FROM (SELECT DISTINCT ON (patient, encounter, code, start) * FROM conditions)),
loads AS (
  SELECT kind, 1 AS loaded, 0 AS already_present, 0 AS conflicts, 0 AS malformed, 0 AS later FROM told WHERE even
  UNION ALL SELECT kind, CAST(NOT broken AND NOT later AND NOT even AS INTEGER), CAST(NOT broken AND NOT later AND even AND NOT altered AS INTEGER),
    CAST(NOT broken AND NOT later AND even AND altered AS INTEGER), CAST(broken AS INTEGER), CAST(NOT broken AND later AS INTEGER) FROM told)
SELECT kind, sum(loaded)::BIGINT AS loaded, sum(already_present)::BIGINT AS already_present, sum(conflicts)::BIGINT AS conflicts,
       sum(malformed)::BIGINT AS malformed, sum(later)::BIGINT AS later FROM loads GROUP BY kind
UNION ALL SELECT 'discharges_unscored', count(*), NULL, NULL, NULL, NULL FROM cohort WHERE stop < TIMESTAMP '{PRELOAD_CUT[:10]}'""")
def preload_twice(spark, d):
    """Both loads summed, and the discharges of the history that the stream will not score."""
    raw = testdata.raw_population(spark, d)
    raw["conditions"] = raw["conditions"].dropDuplicates(list(TABLES["conditions"].key))
    raw = {n: materialize(df) for n, df in raw.items()}
    store = EventStore(spark, scratch_path(spark, "state"))
    half = {n: df.filter(F.col(TABLES[n].entity).cast("long") % 2 == 0) for n, df in raw.items()}
    changed = {
        **raw,
        "encounters": raw["encounters"].withColumn("ENCOUNTERCLASS", F.expr("if(bigint(Id) % 19 = 0, 'zz-other', ENCOUNTERCLASS)")),
        "medications": raw["medications"].withColumn("START", F.expr("if(bigint(ENCOUNTER) % 23 = 0, 'not a time', START)")),
    }
    both = preload(store, half).unionByName(preload(store, changed, before=PRELOAD_CUT))
    names = ("loaded", "already_present", "conflicts", "malformed", "later")
    none = F.lit(None).cast("long")
    skipped = training_window(common.cohort(spark, d), PRELOAD_CUT).agg(F.count("*").alias("loaded")).select(
        F.lit("discharges_unscored").alias("kind"), "loaded", *[none.alias(n) for n in names[1:]]
    )
    return both.groupBy("kind").agg(*[F.sum(n).alias(n) for n in names]).unionByName(skipped)
