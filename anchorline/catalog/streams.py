"""Streaming queries: each runs over a file source derived from the whole tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from anchorline.catalog import common
from anchorline.catalog.anchors import ISO
from anchorline.catalog.audits import B, END, GRID, LOGS, START, predictions, releases
from anchorline.catalog.ordering import SPLICES
from anchorline.catalog.registry import query
from anchorline.catalog.temporal import FEATURES_SQL
from anchorline.catalog.validation import EVENTS
from anchorline.contracts import FEATURE_COLUMNS, LABEL_WINDOW_DAYS, TABLES
from anchorline.functions.scalar import due_at, iso
from anchorline.operators.order import event_stream
from anchorline.session import scratch_path
from anchorline.sources import testdata
from anchorline.sources.envelopes import stream_lines, write_envelopes
from anchorline.streaming import ingest as arrival
from anchorline.streaming import monitoring, release


@contextmanager
def one_partition_per_core(spark):
    """State keeps the partition count of its query's first run; these queries run on one machine."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _ingested(spark, lines, name, keep=lambda outcomes: outcomes, **options):
    """What is kept of the outcomes of a set of event lines, run through the stateful stream."""
    arrival.use_state_store(spark)
    source, out = scratch_path(spark, f"{name}-lines"), scratch_path(spark, f"{name}-out")
    lines.write.option("compression", "gzip").text(source)
    with one_partition_per_core(spark):
        monitoring.run_available(
            keep(arrival.ingest(stream_lines(spark, source), **options)), scratch_path(spark, f"{name}-checkpoint"), path=out
        )
    return spark.read.parquet(out)


def _served(outcomes):
    """The features of the admitted discharges: what a scorer reads of the stream, written in place of every outcome."""
    return arrival.admitted_features(outcomes).selectExpr(
        "bigint(encounter_id) AS encounter_id", "bigint(patient_id) AS patient_id", *FEATURE_COLUMNS[2:]
    )


@query("stream_features", FEATURES_SQL)
def stream_features(spark, d):
    return _ingested(spark, write_envelopes(testdata.raw_population(spark, d)), "features", keep=_served)


# Some patients stay unknown; some stays are posted twice, some again with another class.
@query("stream_outcomes", """
, copies AS (SELECT id, patient, encounter_class, stop, 0 AS c FROM encounters
  UNION ALL SELECT id, patient, encounter_class, stop, 1 FROM encounters WHERE id % 7 = 0
  UNION ALL SELECT id, patient, encounter_class, stop, 2 FROM encounters WHERE id % 11 = 1)
SELECT 'encounter' AS kind, CASE WHEN stop IS NOT NULL AND patient % 20 = 3 THEN 'refused_no_demographics'
    WHEN c = 2 THEN 'conflict' WHEN c = 1 THEN 'duplicate'
    WHEN stop IS NOT NULL AND encounter_class = 'inpatient' THEN 'discharge' ELSE 'stored' END AS outcome, count(*) AS n FROM copies GROUP BY ALL
UNION ALL SELECT 'patient', 'stored', count(*) FROM patients WHERE id % 20 <> 3""")
def stream_outcomes(spark, d):
    raw = testdata.raw_population(spark, d)
    stays = raw["encounters"]
    again = stays.filter("bigint(Id) % 7 = 0")
    altered = stays.filter("bigint(Id) % 11 = 1").withColumn("ENCOUNTERCLASS", F.lit("zz-other"))
    people = raw["patients"].filter("bigint(Id) % 20 <> 3")
    lines = write_envelopes({"patients": people, "encounters": stays.unionByName(again).unionByName(altered)})
    return _ingested(spark, lines, "outcomes").groupBy("kind", "outcome").agg(F.count("*").alias("n"))


# Rows that are refused for want of demographics do not count towards the cap.
@query("stream_row_cap", """
, marked AS (SELECT *, stop IS NOT NULL AND patient % 20 = 3 AS unknown,
    coalesce(strftime(stop, '%Y-%m-%dT%H:%M:%SZ'), 'open:' || strftime(start, '%Y-%m-%dT%H:%M:%SZ')) AS "at" FROM encounters),
ranked AS (SELECT *, row_number() OVER (PARTITION BY patient, unknown ORDER BY "at", encounter_class, CAST(id AS VARCHAR)) AS nth FROM marked)
SELECT patient, count(*) FILTER (WHERE unknown) AS no_demographics, count(*) FILTER (WHERE NOT unknown AND nth > 4) AS over_cap,
       count(*) FILTER (WHERE NOT unknown AND nth <= 4 AND stop IS NOT NULL AND encounter_class = 'inpatient') AS discharges,
       count(*) FILTER (WHERE NOT unknown AND nth <= 4 AND NOT (stop IS NOT NULL AND encounter_class = 'inpatient')) AS stored
FROM ranked GROUP BY patient""")
def stream_row_cap(spark, d):
    raw = testdata.raw_population(spark, d)
    people = raw["patients"].filter("bigint(Id) % 20 <> 3")
    lines = write_envelopes({"patients": people, "encounters": raw["encounters"]})
    outcomes = _ingested(spark, lines, "row-cap", max_rows=4).filter("kind = 'encounter'")
    count = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.groupBy(F.col("patient").cast("bigint").alias("patient")).agg(
        count("refused_no_demographics").alias("no_demographics"), count("refused_row_cap").alias("over_cap"),
        count("discharge").alias("discharges"), count("stored").alias("stored"),
    )


def _file_stream(spark, df, name, files=None, order=None):
    path = scratch_path(spark, name)
    if files:
        df = df.repartitionByRange(files, order)
    df.write.parquet(path)
    reader = spark.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", 1) if files else reader).parquet(path)


@query("stream_label_release", f"""
SELECT encounter_id, label, {ISO.format('stop + to_days(30)')} AS due_at FROM cohort JOIN labelled USING (encounter_id)
WHERE stop + to_days(30) <= (SELECT max(stop) FROM encounters)""")
def stream_label_release(spark, d):
    """The last label is due at the very instant of the last arrival for some tables, and is released."""
    schedule = common.scored(spark, d).select(
        F.col("patient_id").alias("entity"), "encounter_id", "label", due_at("stop", LABEL_WINDOW_DAYS).alias("due_at")
    )
    arrivals = testdata.encounters(spark, d).filter("stop IS NOT NULL").select("id", "stop")
    arrival.use_state_store(spark)
    out = scratch_path(spark, "releases")
    labels = release.released_labels(
        _file_stream(spark, schedule, "schedule"), _file_stream(spark, arrivals, "arrivals", 4, "stop"), "stop"
    )
    with one_partition_per_core(spark):
        monitoring.run_available(labels, scratch_path(spark, "release-checkpoint"), path=out)
    return spark.read.parquet(out).select(F.col("encounter_id").cast("long").alias("encounter_id"), "label", iso("due_at").alias("due_at"))


# A marker ends the source, so the windows of the last weeks come out as well.
@query("stream_window_counts", LOGS + GRID + f"""
SELECT {B} AS boundary, count(*) AS events FROM (SELECT TIMESTAMP '{START}' + to_days(CAST(7 * k AS INTEGER)) AS boundary FROM range(1, 3000) t(k))
JOIN predictions ON event_time >= greatest(TIMESTAMP '{START}', boundary - to_days(30)) AND event_time < boundary GROUP BY 1""")
def stream_window_counts(spark, d):
    rows = predictions(spark, d).select("encounter_id", "event_time")
    last = rows.agg(F.max("event_time").cast("string")).first()[0] or START
    marker, closing = monitoring.closing_marker(spark, rows.schema, "event_time", last)
    source, out, check = (scratch_path(spark, f"window-{n}") for n in ("events", "counts", "checkpoint"))
    with one_partition_per_core(spark):
        # The events, and in a later run of the same query the end of them.
        for part in (rows, marker):
            part.write.mode("append").parquet(source)
            events = spark.readStream.schema(rows.schema).parquet(source).withWatermark("event_time", "0 seconds")
            monitoring.run_available(monitoring.sliding_counts(events, "event_time", START, closing=closing), check, path=out)
    return spark.read.parquet(out).select(iso("boundary").alias("boundary"), "events")


# Scores are missing for every tenth encounter; the stream begins with the log and emits no other discharge.
@query("stream_rescore", LOGS + FEATURES_SQL + " ANTI JOIN predictions USING (encounter_id)")
def stream_rescore(spark, d):
    lines = write_envelopes(testdata.raw_population(spark, d))
    return _ingested(spark, lines, "rescore", keep=_served, log=arrival.scored_encounters(predictions(spark, d)))


# Every thirteenth stay from before the cut is held back and posted behind it. Those within thirty days of the newest
# instant posted before are in time; older ones are late, and count for nothing.
LATE_CUT, SLACK = "1997-06-01", 30


@query("stream_late_rows", f"""
, posted AS (SELECT *, stop IS NOT NULL AND stop < TIMESTAMP '{LATE_CUT}' AND id % 13 = 0 AS held,
             stop IS NOT NULL AND (stop >= TIMESTAMP '{LATE_CUT}' OR id % 13 = 0) AS second FROM encounters),
mark AS (SELECT max(newest) - to_days({SLACK}) AS mark FROM (
  SELECT max(stop) AS newest FROM posted WHERE NOT second UNION ALL SELECT max(start) FROM medications WHERE start < TIMESTAMP '{LATE_CUT}')),
told AS (SELECT *, second AND stop < mark AS late FROM posted, mark)
SELECT e.id AS encounter_id,
       CASE WHEN late THEN 'late' WHEN stop IS NOT NULL AND encounter_class = 'inpatient' THEN 'discharge' ELSE 'stored' END AS outcome,
       CASE WHEN NOT late AND stop IS NOT NULL AND encounter_class = 'inpatient' THEN
         (SELECT count(*) FROM told o WHERE o.patient = e.patient AND o.encounter_class = 'inpatient' AND NOT o.late AND o.stop < e.stop
            AND o.stop >= e.stop - to_days(180) AND NOT (o.second AND NOT e.second)) END AS prior_inpatient,
       CASE WHEN NOT late AND stop IS NOT NULL AND encounter_class = 'inpatient' THEN
         (SELECT count(*) FROM medications m WHERE m.patient = e.patient AND m.start <= e.stop AND (m.stop IS NULL OR m.stop > e.stop)
            AND NOT (m.start >= TIMESTAMP '{LATE_CUT}' AND NOT e.second)) END AS medications
FROM told e""")
def stream_late_rows(spark, d):
    raw = testdata.raw_population(spark, d)
    raw["medications"] = raw["medications"].dropDuplicates(list(TABLES["medications"].key))
    arrival.use_state_store(spark)
    source, out, check = (scratch_path(spark, f"late-{n}") for n in ("lines", "out", "checkpoint"))
    stays, courses = raw["encounters"], raw["medications"]
    second = (F.col("STOP") != "") & ((F.col("STOP") >= LATE_CUT) | (F.col("Id").cast("long") % 13 == 0))
    parts = (
        {"patients": raw["patients"], "encounters": stays.filter(~second), "medications": courses.filter(F.col("START") < LATE_CUT)},
        {"encounters": stays.filter(second), "medications": courses.filter(F.col("START") >= LATE_CUT)},
    )
    with one_partition_per_core(spark):
        for part in parts:
            write_envelopes(part).write.mode("append").option("compression", "gzip").text(source)
            monitoring.run_available(arrival.ingest(stream_lines(spark, source), slack_days=SLACK), check, path=out)
    return spark.read.parquet(out).filter("kind = 'encounter'").select(
        F.expr("bigint(split(event_key, '[|]')[1])").alias("encounter_id"), "outcome",
        F.when(F.col("outcome") == "discharge", F.col("inpatient_now")).alias("prior_inpatient"),
        F.when(F.col("outcome") == "discharge", F.col("active_medications")).alias("medications"),
    )


@query("window_counts_by_class", GRID + f"""
SELECT {B} AS boundary, encounter_class, count(*) AS events FROM (
  SELECT TIMESTAMP '{START}' + to_days(CAST(7 * k AS INTEGER)) AS boundary FROM range(1, 3000) t(k))
JOIN encounters ON stop >= greatest(TIMESTAMP '{START}', boundary - to_days(30)) AND stop < boundary GROUP BY ALL""")
def window_counts_by_class(spark, d):
    stays = testdata.encounters(spark, d).filter("stop IS NOT NULL")
    return monitoring.sliding_counts(stays, "stop", START, ("encounter_class",)).select(
        iso("boundary").alias("boundary"), "encounter_class", "events"
    )


@query("stream_splice", EVENTS + """
SELECT population, kind, count(*) AS events FROM (SELECT *, CASE WHEN entity % 2 = 0 THEN 'even' ELSE 'odd' END AS population FROM stream)
WHERE (population = 'even' AND (("at" >= '1997-01-01T00:00:00Z' AND "at" < '1998-01-01T00:00:00Z') OR "at" >= '1999-01-01T00:00:00Z'))
  OR (population = 'odd' AND "at" >= '1998-01-01T00:00:00Z' AND "at" < '1999-01-01T00:00:00Z') GROUP BY ALL""")
def stream_splice(spark, d):
    events = event_stream(testdata.raw_population(spark, d)).drop("payload")
    parts = {n: _file_stream(spark, events.filter(f"bigint(entity) % 2 = {r}"), f"splice-{n}") for n, r in (("even", 0), ("odd", 1))}
    out = scratch_path(spark, "splice-out")
    monitoring.run_available(monitoring.owned_events(parts, SPLICES), scratch_path(spark, "splice-checkpoint"), path=out)
    return spark.read.parquet(out).groupBy("population", "kind").agg(F.count("*").alias("events"))


@query("stream_realized", LOGS + GRID + f"""
, known AS (SELECT boundary, score, label FROM windows JOIN (SELECT p.event_time, p.score, r.label, r.released_at
     FROM predictions p JOIN releases r USING (prediction_id)) ON event_time >= TIMESTAMP '{START}' AND event_time >= boundary - to_days(60) AND event_time < boundary - to_days(30)
       AND released_at <= boundary),
agg AS (SELECT boundary, count(*) AS n FROM known GROUP BY 1),
auc AS (SELECT p.boundary, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS auroc
        FROM known p JOIN known n ON n.boundary = p.boundary AND n.label = 0 WHERE p.label = 1 GROUP BY 1)
SELECT {B} AS boundary, coalesce(n, 0) AS count, round(auroc, 9) AS auroc FROM windows LEFT JOIN agg USING (boundary) LEFT JOIN auc USING (boundary)""")
def stream_realized(spark, d):
    from anchorline.session import materialize

    # Only what the windows read is kept of the log.
    log, labels = materialize(predictions(spark, d).select("prediction_id", "event_time", "score")), materialize(releases(spark, d))
    released = labels.join(log.select("prediction_id", "event_time"), "prediction_id").select("prediction_id", "event_time", "released_at")
    out = scratch_path(spark, "realized")
    monitoring.run_available(
        _file_stream(spark, released, "released-labels"), scratch_path(spark, "realized-checkpoint"),
        handler=monitoring.realized_sink(lambda: log, lambda: labels, START, END, out),
    )
    return monitoring.realized_table(spark, out, START, END).select(
        iso("boundary").alias("boundary"), "count", F.round("auroc", 9).alias("auroc")
    )
