"""Reconciliation, audits and monitoring over logs derived from the scored rows.

The logs carry planted faults: predictions that are missing, unexpected or changed, and labels
that are missing, flipped or early.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalog import common
from anchorline.catalog.anchors import ISO
from anchorline.catalog.evaluation import PAIRS
from anchorline.catalog.registry import SCORE_SQL, holdout_sql, query
from anchorline.contracts import COHORT_VERSION, FEATURE_VERSION, FLAGS, MODEL_INPUTS, SIGNAL_BAND, SPLIT_SEED
from anchorline.functions.hashing import payload_hash
from anchorline.functions.scalar import iso
from anchorline.operators import monitor
from anchorline.operators.joins import keyed_difference, table_difference
from anchorline.plans import audit
from anchorline.plans.cohort import classify_encounters
from anchorline.plans.reference import build_reference
from anchorline.session import materialize, scratch_path
from anchorline.sources import testdata
from anchorline.sources.logs import LabelLog, PredictionLog, logged_features

START, END, CUTOFF = "1999-01-01", "2001-09-01", "1999-01-01"

LOGS = f"""
, hashes AS (SELECT id AS encounter_id, sha256('{{"event_type":"encounter","payload":{{"ENCOUNTERCLASS":"' || encounter_class
     || '","Id":"' || id || '","PATIENT":"' || patient || '","START":"' || {ISO.format('start')} || '","STOP":"'
     || coalesce({ISO.format('stop')}, '') || '"}}}}') AS h FROM encounters),
predictions AS (
  SELECT encounter_id AS prediction_id, patient_id, encounter_id, stop AS event_time,
         CASE WHEN encounter_id % 61 = 2 THEN upper(h) ELSE h END AS input_hash, 'readmission-trees' AS model_name,
         CAST(1 + CAST(encounter_id % 2 = 0 AS INTEGER) AS INTEGER) AS model_version,
         CASE WHEN encounter_id % 17 = 0 THEN '1.0.4' ELSE '1.1.3' END AS feature_version, '1.0.0' AS cohort_version,
         CASE WHEN encounter_id % 31 = 3 THEN score + 0.001 ELSE score END AS score
  FROM scored JOIN hashes USING (encounter_id) WHERE encounter_id % 10 <> 4
  UNION ALL
  SELECT id, patient, id, stop, h, 'readmission-trees', 1, '1.1.3', '1.0.0', 0.5
  FROM classified JOIN hashes ON encounter_id = id WHERE reason = 'under_18' AND id % 5 = 0),
releases AS (
  SELECT prediction_id, encounter_id, CASE WHEN encounter_id % 41 = 5 THEN 1 - label ELSE label END AS label,
         stop + to_days(30) AS due_at,
         stop + to_days(30) + CASE WHEN encounter_id % 53 = 7 THEN -to_days(2) ELSE to_days(CAST(encounter_id % 5 AS INTEGER)) END
           AS released_at
  FROM predictions JOIN (SELECT encounter_id, label, stop FROM scored) USING (encounter_id) WHERE encounter_id % 3 <> 0)
"""


def predictions(spark, d):
    # A stay's hash is made of the row at hand: looking it up would send every encounter through a join for each reader.
    start, stop = testdata.instant_text("start"), testdata.instant_text("stop")
    hashed = lambda df, id, patient: df.withColumn(
        "input_hash", payload_hash("encounter", testdata.encounter_cells(id, patient, F.lit("inpatient"), start, stop))
    )
    log = hashed(common.scored(spark, d), "encounter_id", "patient_id").filter("encounter_id % 10 <> 4").selectExpr(
        "encounter_id AS prediction_id", "patient_id", "encounter_id", "stop AS event_time",
        "if(encounter_id % 61 = 2, upper(input_hash), input_hash) AS input_hash", "'readmission-trees' AS model_name",
        "1 + int(encounter_id % 2 = 0) AS model_version", "if(encounter_id % 17 = 0, '1.0.4', '1.1.3') AS feature_version",
        "'1.0.0' AS cohort_version", "if(encounter_id % 31 = 3, score + 0.001D, score) AS score",
    )
    f = common.frames(spark, d)
    stays = f["encounters"].filter("encounter_class = 'inpatient' AND id % 5 = 0")
    minors = classify_encounters(stays, f["patients"]).filter("exclusion_reason = 'under_18'")
    extra = hashed(minors, "id", "patient").selectExpr(
        "id AS prediction_id", "patient AS patient_id", "id AS encounter_id", "stop AS event_time",
        "input_hash", "'readmission-trees' AS model_name", "1 AS model_version",
        "'1.1.3' AS feature_version", "'1.0.0' AS cohort_version", "0.5D AS score",
    )
    return log.unionByName(extra)


def releases(spark, d):
    # Labels are of scored rows only, and a prediction has its encounter's number: those logged are told without a join.
    return common.scored(spark, d).filter("encounter_id % 10 <> 4 AND encounter_id % 3 <> 0").selectExpr(
        "encounter_id AS prediction_id", "encounter_id", "if(encounter_id % 41 = 5, 1 - label, label) AS label",
        "stop + INTERVAL 30 DAYS AS due_at",
        "stop + INTERVAL 30 DAYS + make_dt_interval(if(encounter_id % 53 = 7, -2, int(encounter_id % 5))) AS released_at",
    )


@query("reconcile_log", LOGS + f"""
SELECT coalesce(c.encounter_id, p.encounter_id) AS encounter_id,
       CASE WHEN p.encounter_id IS NULL THEN 'unscored' WHEN c.encounter_id IS NULL THEN 'unexpected'
            WHEN c.stop >= TIMESTAMP '{CUTOFF}' THEN 'held_out' ELSE 'pre_cutoff' END AS bucket
FROM cohort c FULL JOIN predictions p ON p.encounter_id = c.encounter_id""")
def reconcile_log(spark, d):
    return audit.partition_log(common.scored(spark, d), predictions(spark, d), CUTOFF)


@query("label_audit", LOGS + """
SELECT r.encounter_id, r.label, l.label AS expected FROM releases r LEFT JOIN labelled l USING (encounter_id)
WHERE r.label IS DISTINCT FROM l.label""")
def label_audit(spark, d):
    return audit.label_audit(releases(spark, d), common.scored(spark, d))


@query("early_labels", LOGS + """
SELECT count(*) AS early FROM releases JOIN predictions USING (prediction_id) WHERE released_at < event_time + to_days(30)""")
def early_labels(spark, d):
    return audit.early_labels(predictions(spark, d), releases(spark, d))


@query("unlabelled_predictions", LOGS + f"""
SELECT count(*) AS unlabelled, {ISO.format('min(event_time)')} AS earliest FROM predictions ANTI JOIN releases USING (prediction_id)""")
def unlabelled(spark, d):
    return audit.unlabelled(predictions(spark, d), releases(spark, d)).withColumn("earliest", iso("earliest"))


@query("unscored_discharges", LOGS + "SELECT encounter_id FROM cohort ANTI JOIN predictions USING (encounter_id)")
def unscored(spark, d):
    return audit.unscored(common.scored(spark, d).select("encounter_id"), predictions(spark, d))


@query("table_difference", LOGS + """
, lhs AS (SELECT encounter_id, score FROM scored), rhs AS (SELECT encounter_id, score FROM predictions)
SELECT coalesce(l.encounter_id, r.encounter_id) AS encounter_id, coalesce(l.score, r.score) AS score,
       CAST(l.encounter_id IS NOT NULL AS BIGINT) AS left_copies, CAST(r.encounter_id IS NOT NULL AS BIGINT) AS right_copies
FROM lhs l FULL JOIN rhs r ON l.encounter_id = r.encounter_id AND l.score = r.score
WHERE l.encounter_id IS NULL OR r.encounter_id IS NULL""")
def difference(spark, d):
    pick = lambda df: df.select("encounter_id", "score")
    return table_difference(pick(common.scored(spark, d)), pick(predictions(spark, d)))


@query("keyed_difference", LOGS + """
SELECT coalesce(l.encounter_id, r.encounter_id) AS encounter_id,
       CASE WHEN l.encounter_id IS NULL THEN 'missing_left' WHEN r.encounter_id IS NULL THEN 'missing_right' ELSE 'score' END AS differences
FROM scored l FULL JOIN predictions r ON l.encounter_id = r.encounter_id
WHERE l.score IS DISTINCT FROM r.score""")
def keyed(spark, d):
    pick = lambda df: df.select("encounter_id", "patient_id", "score")
    return keyed_difference(pick(common.scored(spark, d)), pick(predictions(spark, d)), ["encounter_id"]).select(
        "encounter_id", F.concat_ws(",", "differences").alias("differences")
    )


@query("acknowledged_mismatches", LOGS + """
SELECT p.encounter_id FROM predictions p JOIN scored s USING (encounter_id) JOIN hashes h USING (encounter_id)
WHERE p.score <> s.score OR p.input_hash <> h.h""")
def acknowledged(spark, d):
    # Only inpatient stays are scored, so no other line is hashed.
    stays = testdata.raw_population(spark, d)["encounters"].filter("ENCOUNTERCLASS = 'inpatient'")
    hashes = audit.source_hashes(stays).selectExpr(
        "bigint(encounter_id) AS encounter_id", "recomputed_hash AS input_hash"
    )
    acks = common.scored(spark, d).select("encounter_id", "score").join(hashes, "encounter_id")
    return audit.acknowledged_mismatches(acks, predictions(spark, d))


@query("provenance", LOGS + """
SELECT p.encounter_id, p.input_hash = h.h AS hash_matches, coalesce(p.score = s.score, false) AS score_matches,
       round(abs(p.score - s.score), 9) AS gap
FROM predictions p JOIN hashes h USING (encounter_id) LEFT JOIN (SELECT encounter_id, score FROM scored) s USING (encounter_id)""")
def provenance(spark, d):
    # Rescored from the features as logged, by the same expression the log's model stands for.
    logged = logged_features(common.scored(spark, d), MODEL_INPUTS)
    rescored = logged.select("encounter_id", *[F.col("features")[n].alias(n) for n in MODEL_INPUTS]).select(
        "encounter_id", F.expr(SCORE_SQL).alias("rescored")
    )
    raw = testdata.raw_population(spark, d)["encounters"].withColumn("Id", F.col("Id").cast("long"))
    checked = audit.verify_predictions(
        predictions(spark, d), raw.withColumn("Id", F.col("Id").cast("string")),
        rescored.withColumn("encounter_id", F.col("encounter_id")),
    )
    return checked.selectExpr("bigint(encounter_id) AS encounter_id", "hash_matches", "score_matches", "round(gap, 9) AS gap")


# The log itself is the source: written, read back, and every score made anew from the features it holds.
@query("provenance_of_log", LOGS + """
SELECT p.encounter_id, true AS has_source, p.input_hash = h.h AS hash_matches, p.score = s.score AS score_matches,
       round(abs(p.score - s.score), 9) AS gap FROM predictions p JOIN hashes h USING (encounter_id) JOIN scored s USING (encounter_id)""")
def provenance_of_log(spark, d):
    log = PredictionLog(spark, scratch_path(spark, "predictions"))
    inputs = logged_features(common.scored(spark, d), MODEL_INPUTS).select(F.col("encounter_id").cast("string").alias("encounter_id"), "features")
    log.record(_loggable(spark, d).drop("features").join(inputs, "encounter_id"))
    raw = testdata.raw_population(spark, d)["encounters"]
    checked = audit.verify_log(log.read(), raw, lambda rows: rows.withColumn("score", F.expr(SCORE_SQL)), MODEL_INPUTS)
    return checked.select(
        F.col("encounter_id").cast("long").alias("encounter_id"), "has_source", "hash_matches", "score_matches", F.round("gap", 9).alias("gap")
    )


@query("logged_models", LOGS + "SELECT DISTINCT model_name, model_version FROM predictions")
def logged_models(spark, d):
    return audit.logged_models(predictions(spark, d))


@query("latest_model", LOGS + """
SELECT model_name, max(model_version) AS model_version, CAST(arg_max(encounter_id, (event_time, encounter_id)) AS BIGINT) AS latest_encounter
FROM predictions GROUP BY 1""")
def latest_model(spark, d):
    return predictions(spark, d).groupBy("model_name").agg(
        F.max("model_version").alias("model_version"),
        F.max_by("encounter_id", F.struct("event_time", "encounter_id")).alias("latest_encounter"),
    )


# The log already holds predictions of odd encounters; the whole batch is posted again.
def _loggable(spark, d):
    ids = {c: F.col(c).cast("string") for c in ("patient_id", "encounter_id")}
    return predictions(spark, d).drop("prediction_id").withColumns(ids).withColumn(
        "features", F.create_map(F.lit("score"), F.col("score"))
    )


# Half of the discharges are scored first; then all are offered again with another score, some of them twice.
@query("prediction_sink", LOGS + """
SELECT row_number() OVER (ORDER BY encounter_id % 2, event_time, CAST(encounter_id AS VARCHAR)) AS prediction_id, encounter_id,
       CASE WHEN encounter_id % 2 = 0 THEN score ELSE score + 1 END AS score FROM predictions""")
def prediction_sink(spark, d):
    log, rows = PredictionLog(spark, scratch_path(spark, "predictions")), _loggable(spark, d)
    log.record(rows.filter("bigint(encounter_id) % 2 = 0"))
    again = rows.withColumn("score", F.col("score") + 1)
    log.record(again.unionByName(again.filter("bigint(encounter_id) % 3 = 0").withColumn("score", F.col("score") + 1)))
    return log.all().selectExpr("prediction_id", "bigint(encounter_id) AS encounter_id", "score")


# Each label comes twice, the second time later and flipped; then everything is offered once more.
@query("label_sink", LOGS + f"""
SELECT row_number() OVER (ORDER BY due_at, CAST(encounter_id AS VARCHAR)) AS label_id, encounter_id, label,
       {ISO.format('released_at')} AS released_at FROM releases WHERE released_at >= due_at""")
def label_sink(spark, d):
    log, labels = PredictionLog(spark, scratch_path(spark, "predictions")), LabelLog(spark, scratch_path(spark, "labels"))
    log.record(_loggable(spark, d))
    due = releases(spark, d).filter("released_at >= due_at").selectExpr(
        "string(encounter_id) AS encounter_id", "label", "'1.0.0' AS label_version", "due_at", "released_at"
    )
    flipped = due.withColumn("label", 1 - F.col("label")).withColumn("released_at", F.expr("released_at + INTERVAL 1 DAY"))
    for _ in range(2):
        labels.record(due.unionByName(flipped), log.read())
    return labels.read().select(
        "label_id", F.col("encounter_id").cast("long").alias("encounter_id"), "label", iso("released_at").alias("released_at")
    )


@query("log_reader", LOGS + f"""
SELECT row_number() OVER (ORDER BY event_time, CAST(encounter_id AS VARCHAR)) AS prediction_id, encounter_id,
       {ISO.format('event_time')} AS event_time, score FROM predictions""")
def log_reader(spark, d):
    log = PredictionLog(spark, scratch_path(spark, "predictions"))
    log.record(_loggable(spark, d))
    return log.all().select(
        "prediction_id", F.col("encounter_id").cast("long").alias("encounter_id"), iso("event_time").alias("event_time"), "score"
    )


@query("labelled_log", LOGS + f"""
SELECT encounter_id, score, label FROM predictions JOIN releases USING (prediction_id, encounter_id)
WHERE event_time >= TIMESTAMP '{START}' AND event_time < TIMESTAMP '{END}'""")
def labelled_log(spark, d):
    joined = audit.joined_labels(predictions(spark, d), releases(spark, d))
    return joined.filter(audit.in_window("event_time", START, END)).select("encounter_id", "score", "label")


WINDOWED = LOGS + f""", windowed AS (SELECT score, label FROM predictions JOIN releases USING (prediction_id)
  WHERE event_time >= TIMESTAMP '{START}' AND event_time < TIMESTAMP '{END}')
SELECT count(*) AS count, round(avg(label), 9) AS prevalence, round({PAIRS.format('windowed')}, 9) AS auroc FROM windowed"""


@query("realized_performance", WINDOWED)
def realized(spark, d):
    return audit.realized_performance(predictions(spark, d), releases(spark, d), START, END).select(
        "count", F.round("prevalence", 9).alias("prevalence"), F.round("auroc", 9).alias("auroc")
    )


@query("batch_performance", f""", windowed AS (SELECT score, label FROM scored WHERE stop >= TIMESTAMP '{START}' AND stop < TIMESTAMP '{END}')
SELECT count(*) AS count, round(avg(label), 9) AS prevalence, round({PAIRS.format('windowed')}, 9) AS auroc FROM windowed""")
def batch_perf(spark, d):
    return audit.batch_performance(common.scored(spark, d), START, END).select(
        "count", F.round("prevalence", 9).alias("prevalence"), F.round("auroc", 9).alias("auroc")
    )


# Monitoring.
GRID = f""", grid AS (SELECT TIMESTAMP '{START}' + to_days(CAST(7 * k AS INTEGER)) AS boundary FROM range(1, 2000) t(k)
  WHERE TIMESTAMP '{START}' + to_days(CAST(7 * k AS INTEGER)) <= TIMESTAMP '{END}'),
windows AS (SELECT boundary, greatest(TIMESTAMP '{START}', boundary - to_days(30)) AS window_start FROM grid)
"""
B = ISO.format("boundary")


# The grid of a run reaches as far as its log.
@query("evaluation_grid", LOGS + GRID + f"""SELECT {B} AS boundary, {ISO.format('window_start')} AS window_start FROM windows
WHERE boundary <= (SELECT max(event_time) FROM predictions)""")
def evaluation_grid(spark, d):
    last = predictions(spark, d).agg(F.max("event_time").cast("string")).first()[0]
    return monitor.grid(spark, START, last).select(iso("boundary").alias("boundary"), iso("window_start").alias("window_start"))


@query("sliding_windows", LOGS + GRID + f"""
SELECT {B} AS boundary, encounter_id FROM windows JOIN predictions ON event_time >= window_start AND event_time < boundary""")
def sliding_windows(spark, d):
    return monitor.in_windows(predictions(spark, d), "event_time", START, END).select(iso("boundary").alias("boundary"), "encounter_id")


COUNTS = LOGS + GRID + f"""
, refusals AS (SELECT stop AS at_ FROM encounters WHERE stop IS NOT NULL AND patient % 13 = 6),
counts AS (SELECT boundary, window_start,
  (SELECT count(*) FROM predictions WHERE event_time >= window_start AND event_time < boundary) AS prediction_count,
  (SELECT count(*) FROM predictions JOIN releases USING (prediction_id) WHERE event_time >= TIMESTAMP '{START}'
     AND released_at <= boundary) AS label_count,
  (SELECT count(*) FROM refusals WHERE at_ >= window_start AND at_ < boundary) AS refusal_count,
  (SELECT count(*) FROM predictions WHERE event_time >= window_start AND event_time < boundary AND feature_version NOT LIKE '1.1.%')
     AS version_mismatch_count FROM windows)
"""


def _counts(spark, d):
    refused = testdata.encounters(spark, d).filter("stop IS NOT NULL AND patient % 13 = 6").selectExpr("stop AS at")
    required = {"feature_version": FEATURE_VERSION, "cohort_version": COHORT_VERSION}
    return monitor.window_counts(predictions(spark, d), releases(spark, d), refused, START, END, required)


@query("window_counts", COUNTS + f"""SELECT {B} AS boundary, {ISO.format('window_start')} AS window_start, prediction_count,
  label_count, refusal_count, version_mismatch_count FROM counts""")
def window_counts(spark, d):
    return _counts(spark, d).withColumns({"boundary": iso("boundary"), "window_start": iso("window_start")})


SIGNALS = (*MODEL_INPUTS, "score")
UNPIVOT = "UNPIVOT (SELECT {0} FROM {1}) ON " + ", ".join(SIGNALS) + " INTO NAME signal VALUE value"
REFERENCE = f"""
, ref_wide AS (SELECT {', '.join(f'CAST({s} AS DOUBLE) AS {s}' for s in MODEL_INPUTS)},
    CASE WHEN {holdout_sql()} THEN score END AS score FROM scored WHERE stop < TIMESTAMP '{CUTOFF}'),
reference AS (SELECT signal, value FROM (UNPIVOT ref_wide ON {', '.join(SIGNALS)} INTO NAME signal VALUE value) WHERE value IS NOT NULL)
"""
LIVE = f"""{GRID}
, live_wide AS (SELECT boundary, {', '.join(f'CAST({s} AS DOUBLE) AS {s}' for s in SIGNALS)}
    FROM windows JOIN scored ON stop >= window_start AND stop < boundary),
live AS (UNPIVOT live_wide ON {', '.join(SIGNALS)} INTO NAME signal VALUE value)
"""


def reference(spark, d):
    return build_reference(common.scored(spark, d), cutoff=CUTOFF, fraction=0.2, seed=SPLIT_SEED)


def live(spark, d):
    rows = monitor.long_form(common.scored(spark, d), SIGNALS, ("stop",))
    return monitor.counted_in_windows(rows, "stop", START, END, ["signal", "value"])


@query("monitoring_reference", REFERENCE + """
SELECT signal, count(*) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high FROM reference GROUP BY 1""")
def monitoring_reference(spark, d):
    return reference(spark, d).groupBy("signal").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
    )


KS_STEPS = """
, refs AS (SELECT signal, value, count(*) AS r FROM reference GROUP BY 1, 2),
mine AS (SELECT boundary, signal, value, count(*) AS l FROM live GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT boundary, signal FROM mine),
steps AS (SELECT boundary, signal, value, sum(r) AS r, sum(l) AS l FROM (
  SELECT boundary, g.signal, value, r, 0 AS l FROM groups g JOIN refs USING (signal)
  UNION ALL SELECT boundary, signal, value, 0, l FROM mine) GROUP BY 1, 2, 3),
curves AS (SELECT boundary, signal, sum(r) OVER w / sum(r) OVER g AS f, sum(l) OVER w / sum(l) OVER g AS q,
   sum(r) OVER g AS n1, sum(l) OVER g AS n2 FROM steps
   WINDOW w AS (PARTITION BY boundary, signal ORDER BY value), g AS (PARTITION BY boundary, signal)),
ks AS (SELECT boundary, signal, max(abs(f - q)) AS ks, max(n1) AS n1, max(n2) AS n2 FROM curves GROUP BY 1, 2),
lambdas AS (SELECT *, ks * sqrt(CAST(n1 AS DOUBLE) * n2 / (n1 + n2)) AS lam FROM ks)
"""


@query("ks_test", REFERENCE + LIVE + KS_STEPS + f"""
SELECT {B} AS boundary, signal, round(ks, 9) AS ks, CAST(n1 AS BIGINT) AS n_reference, CAST(n2 AS BIGINT) AS n_live,
  round(CASE WHEN lam < 0.1 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101),
    lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam))))) END, 6) AS p_value FROM lambdas""")
def ks_test(spark, d):
    return monitor.ks_two_sample(reference(spark, d), live(spark, d)).select(
        iso("boundary").alias("boundary"), "signal", F.round("ks", 9).alias("ks"), "n_reference", "n_live",
        F.round("p_value", 6).alias("p_value"),
    )


PSI_STEPS = """
, edges AS (SELECT signal, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM reference GROUP BY 1),
ref_bins AS (SELECT signal, len(list_filter(edges, lambda e: value > e)) AS bin, count(*) AS n FROM reference JOIN edges USING (signal) GROUP BY 1, 2),
live_bins AS (SELECT boundary, signal, len(list_filter(edges, lambda e: value > e)) AS bin, count(*) AS n FROM live JOIN edges USING (signal) GROUP BY 1, 2, 3),
cells AS (SELECT DISTINCT boundary, signal, bin FROM (SELECT DISTINCT boundary, signal FROM live_bins), range(10) t(bin)),
shares AS (SELECT c.boundary, c.signal, c.bin,
  greatest(coalesce(l.n, 0) / sum(l.n) OVER (PARTITION BY c.boundary, c.signal), 0.0001) AS a,
  greatest(coalesce(r.n, 0) / sum(r.n) OVER (PARTITION BY c.boundary, c.signal), 0.0001) AS e
  FROM cells c LEFT JOIN live_bins l ON l.boundary = c.boundary AND l.signal = c.signal AND l.bin = c.bin
  LEFT JOIN ref_bins r ON r.signal = c.signal AND r.bin = c.bin),
psi AS (SELECT boundary, signal, sum((a - e) * ln(a / e)) AS psi FROM shares GROUP BY 1, 2)
"""


def _psi(spark, d):
    ref = reference(spark, d)
    return monitor.stability_index(ref, live(spark, d), monitor.decile_edges(ref))


PSI = REFERENCE + LIVE + PSI_STEPS


@query("stability_index", PSI + f"SELECT {B} AS boundary, signal, round(psi, 6) AS psi FROM psi")
def stability_index(spark, d):
    return _psi(spark, d).select(iso("boundary").alias("boundary"), "signal", F.round("psi", 6).alias("psi"))


FLAG_LIST = ", ".join(f"'{f}'" for f in FLAGS)


Z_STEPS = f"""
, r AS (SELECT signal, count(*) FILTER (WHERE value = 1) AS x1, count(*) AS n1 FROM reference WHERE signal IN ({FLAG_LIST}) GROUP BY 1),
l AS (SELECT boundary, signal, count(*) FILTER (WHERE value = 1) AS x2, count(*) AS n2 FROM live WHERE signal IN ({FLAG_LIST}) GROUP BY 1, 2),
z AS (SELECT boundary, signal, (x1 / n1 - x2 / n2) / sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)) AS z
      FROM l JOIN r USING (signal))
"""


@query("proportion_tests", REFERENCE + LIVE + Z_STEPS + f"""
, t AS (SELECT *, 1.0 / (1.0 + 0.2316419 * abs(z)) AS t FROM z)
SELECT {B} AS boundary, signal, round(z, 6) AS z, round(2 * 0.3989422804014327 * exp(-z * z / 2) * (0.319381530 * t - 0.356563782 * t ** 2
   + 1.781477937 * t ** 3 - 1.821255978 * t ** 4 + 1.330274429 * t ** 5), 6) AS p_value FROM t""")
def proportion_tests(spark, d):
    flags = F.col("signal").isin(*FLAGS)
    return monitor.proportion_tests(reference(spark, d).filter(flags), live(spark, d).filter(flags)).select(
        iso("boundary").alias("boundary"), "signal", F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value")
    )


THRESHOLDS = {s: 0.5 if s in FLAGS else 0.8 for s in SIGNALS}
THRESHOLD_SQL = "SELECT unnest([" + ", ".join(f"'{s}'" for s in sorted(SIGNALS)) + "]) AS signal, unnest([" + ", ".join(
    f"{THRESHOLDS[s]}::DOUBLE" for s in sorted(SIGNALS)) + "]) AS threshold"


def thresholds(spark):
    """One threshold for each configured signal."""
    limits = [(name, 0.5 if name in FLAGS else 0.8) for name in (*MODEL_INPUTS, "score")]
    return spark.createDataFrame(limits, "signal STRING, threshold DOUBLE")


@query("drift_alerts", PSI + f"""
, limits AS ({THRESHOLD_SQL})
SELECT {B} AS sim_at, signal, round(psi, 6) AS statistic, threshold FROM psi JOIN limits USING (signal) WHERE psi > threshold""")
def drift_alerts(spark, d):
    found = monitor.alerts(_psi(spark, d).withColumnRenamed("psi", "statistic"), thresholds(spark))
    return found.select(iso("sim_at").alias("sim_at"), "signal", F.round("statistic", 6).alias("statistic"), "threshold")


@query("thresholds_hash", REFERENCE + f"""
, limits AS ({THRESHOLD_SQL})
SELECT sha256('[' || string_agg('{{"signal":"' || signal || '","threshold":' || threshold || '}}', ',' ORDER BY signal) || ']') AS thresholds_hash
FROM limits SEMI JOIN reference USING (signal)""")
def thresholds_digest(spark, d):
    # The thresholds in force are those of signals the reference holds.
    return monitor.thresholds_hash(thresholds(spark).join(reference(spark, d).select("signal").distinct(), "signal", "left_semi"))


@query("label_rules", LOGS + """
SELECT prediction_id, 'released_after_due' AS rule FROM releases WHERE released_at < due_at""")
def label_rules(spark, d):
    return monitor.label_violations(releases(spark, d))


@query("evaluation_rules", COUNTS + f"""
SELECT 1 AS run_id, {B} AS boundary, 'one_per_boundary' AS rule FROM counts WHERE prediction_count % 10 = 3
UNION ALL SELECT 1, {B}, 'thresholds_hash_present' FROM counts WHERE prediction_count % 10 = 5""")
def evaluation_rules(spark, d):
    rows = _counts(spark, d).selectExpr("1 AS run_id", "*", "if(prediction_count % 10 = 5, '', 'h') AS thresholds_hash")
    doubled = rows.unionByName(rows.filter("prediction_count % 10 = 3"))
    return monitor.evaluation_violations(doubled).select("run_id", iso("boundary").alias("boundary"), "rule")


@query("reference_rules", LOGS + """
SELECT model_name, model_version, count(*) AS "references" FROM
 (SELECT DISTINCT model_name, model_version, feature_version FROM predictions) GROUP BY 1, 2 HAVING count(*) > 1""")
def reference_rules(spark, d):
    rows = predictions(spark, d).select("model_name", "model_version", "feature_version").distinct()
    return monitor.reference_violations(rows)


@query("realized_by_boundary", LOGS + GRID + f"""
, known AS (SELECT boundary, score, label FROM windows JOIN (SELECT p.event_time, p.score, r.label, r.released_at
     FROM predictions p JOIN releases r USING (prediction_id)) ON event_time >= TIMESTAMP '{START}' AND event_time >= boundary - to_days(60) AND event_time < boundary - to_days(30)
       AND released_at <= boundary),
agg AS (SELECT boundary, count(*) AS n, avg(label) AS prevalence FROM known GROUP BY 1),
auc AS (SELECT p.boundary, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS auroc
        FROM known p JOIN known n ON n.boundary = p.boundary AND n.label = 0 WHERE p.label = 1 GROUP BY 1)
SELECT {B} AS boundary, coalesce(n, 0) AS count, round(prevalence, 9) AS prevalence, round(auroc, 9) AS auroc
FROM windows LEFT JOIN agg USING (boundary) LEFT JOIN auc USING (boundary)""")
def realized_boundaries(spark, d):
    return monitor.realized_by_boundary(predictions(spark, d), releases(spark, d), START, END).select(
        iso("boundary").alias("boundary"), "count", F.round("prevalence", 9).alias("prevalence"), F.round("auroc", 9).alias("auroc")
    )


# The window of the boundary itself: what is known of its discharges by then, which is little.
WINDOW_KNOWN = """
, in_window AS (SELECT boundary, score, label FROM windows JOIN (SELECT p.event_time, p.score, r.label, r.released_at
     FROM predictions p JOIN releases r USING (prediction_id)) ON event_time >= window_start AND event_time < boundary AND released_at <= boundary)
"""


@query("realized_by_window", LOGS + GRID + WINDOW_KNOWN + f"""
, sums AS (SELECT boundary, count(*) AS n, avg(label) AS prevalence FROM in_window GROUP BY 1),
auc AS (SELECT p.boundary, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS auroc
        FROM in_window p JOIN in_window n ON n.boundary = p.boundary AND n.label = 0 WHERE p.label = 1 GROUP BY 1)
SELECT {B} AS boundary, coalesce(n, 0) AS count, round(prevalence, 9) AS prevalence, round(auroc, 9) AS auroc
FROM windows LEFT JOIN sums USING (boundary) LEFT JOIN auc USING (boundary)""")
def realized_windows(spark, d):
    return monitor.realized_by_boundary(predictions(spark, d), releases(spark, d), START, END, lag_days=0).select(
        iso("boundary").alias("boundary"), "count", F.round("prevalence", 9).alias("prevalence"), F.round("auroc", 9).alias("auroc")
    )


# One limit for each kind of statistic; the floor of the realized AUROC is the gate's.
LIMITS = {"psi": 0.8, "ks": 0.5, "z": 4.0, "realized": 0.0}
FLOOR = SIGNAL_BAND[0]
STATISTICS = REFERENCE + LOGS + LIVE + KS_STEPS + PSI_STEPS + Z_STEPS + f"""
, mature AS (SELECT boundary, score, label FROM windows JOIN (SELECT p.event_time, p.score, r.label, r.released_at
     FROM predictions p JOIN releases r USING (prediction_id)) ON event_time >= TIMESTAMP '{START}' AND event_time >= boundary - to_days(60)
       AND event_time < boundary - to_days(30) AND released_at <= boundary),
mature_auc AS (SELECT p.boundary, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS auroc
     FROM mature p JOIN mature n ON n.boundary = p.boundary AND n.label = 0 WHERE p.label = 1 GROUP BY 1),
statistics AS (SELECT boundary, 'psi:' || signal AS signal, psi AS statistic FROM psi UNION ALL SELECT boundary, 'ks:' || signal, ks FROM ks
  UNION ALL SELECT boundary, 'z:' || signal, abs(z) FROM z WHERE z IS NOT NULL AND NOT isnan(z)
  UNION ALL SELECT boundary, 'realized:auroc_shortfall', {FLOOR} - auroc FROM mature_auc)
"""


def _statistics(spark, d):
    # Both samples are counted once, and every statistic reads the counts.
    rows = reference(spark, d)
    ref = materialize(rows.groupBy("signal", "value").agg(F.count("*").alias("n")))
    seen = materialize(live(spark, d))
    flags = F.col("signal").isin(*FLAGS)
    return monitor.all_statistics(
        monitor.stability_index(ref, seen, monitor.decile_edges(rows)), monitor.ks_two_sample(ref, seen),
        monitor.proportion_tests(ref.filter(flags), seen.filter(flags)),
        monitor.realized_by_boundary(predictions(spark, d), releases(spark, d), START, END), FLOOR,
    )


@query("alerts_of_all_signals", STATISTICS + f"""
SELECT {B} AS sim_at, signal, round(statistic, 6) AS statistic, threshold FROM statistics
JOIN (SELECT unnest([{', '.join(f"'{k}'" for k in LIMITS)}]) AS kind, unnest([{', '.join(f'{v}::DOUBLE' for v in LIMITS.values())}]) AS threshold)
  ON kind = split_part(signal, ':', 1) WHERE statistic > threshold""")
def all_alerts(spark, d):
    found = _statistics(spark, d)
    limits = found.select("signal").distinct().withColumn(
        "threshold", F.element_at(F.create_map(*[x for k, v in LIMITS.items() for x in (F.lit(k), F.lit(v))]), F.split("signal", ":")[0])
    )
    return monitor.alerts(found, limits).select(iso("sim_at").alias("sim_at"), "signal", F.round("statistic", 6).alias("statistic"), "threshold")


@query("evaluation_log", STATISTICS + f"""
, told AS (SELECT boundary, string_agg(signal || '=' || printf('%.4f', round(statistic, 4)), ',' ORDER BY signal) AS statistics FROM statistics GROUP BY 1)
SELECT {B} AS boundary, {ISO.format('window_start')} AS window_start,
  (SELECT count(*) FROM predictions WHERE event_time >= window_start AND event_time < boundary) AS prediction_count,
  coalesce(statistics, '') AS statistics, 'readmission-trees/1' AS reference
FROM windows LEFT JOIN told USING (boundary)""")
def evaluation_log(spark, d):
    digest = monitor.thresholds_hash(thresholds(spark)).first()[0]
    rows = monitor.evaluation_rows(_counts(spark, d), _statistics(spark, d), digest, "readmission-trees/1")
    told = F.array_join(F.transform(
        F.array_sort(F.map_entries("statistics")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", F.round(e["value"], 4)))
    ), ",")
    return rows.select(iso("boundary").alias("boundary"), iso("window_start").alias("window_start"), "prediction_count", told.alias("statistics"), "reference")
