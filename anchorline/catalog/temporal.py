"""As-of operators, on the clinical views and on the generic event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalog import common
from anchorline.catalog.registry import query
from anchorline.contracts import FEATURE_COLUMNS, FLAGS
from anchorline.functions.scalar import DAY, iso
from anchorline.operators import timeline
from anchorline.operators.windows import readable_rows
from anchorline.plans.cohort import build_cohort
from anchorline.plans.features import anchor_rows, build_features
from anchorline.plans.serving import serving_features
from anchorline.sources import testdata

FEATURES_SQL = "SELECT " + ", ".join(FEATURE_COLUMNS) + " FROM features"


@query("features", FEATURES_SQL)
def features(spark, d):
    return common.features(spark, d)


@query("labels", "SELECT encounter_id, label FROM labelled")
def labels(spark, d):
    return common.labels(spark, d)


@query("training_rows", "SELECT " + ", ".join(FEATURE_COLUMNS) + ", label FROM features JOIN labelled USING (encounter_id)")
def training_rows(spark, d):
    return common.build_training_rows(common.frames(spark, d)).drop("start", "stop")


def _stays(spark, d):
    return testdata.encounters(spark, d).filter("stop IS NOT NULL").selectExpr(
        "patient", "unix_micros(stop) AS at", "encounter_class"
    )


def _anchors(spark, d):
    return anchor_rows(common.cohort(spark, d)).select("encounter_id", "patient", "at")


@query("prior_stays_180d", "SELECT encounter_id, prior_inpatient_180d FROM features")
def prior_stays(spark, d):
    return timeline.trailing_count(
        _anchors(spark, d), _stays(spark, d), entity="patient", at="at", span=180 * DAY,
        counts={"prior_inpatient_180d": F.col("encounter_class") == "inpatient"},
    ).select("encounter_id", F.col("prior_inpatient_180d").cast("int").alias("prior_inpatient_180d"))


@query("active_intervals", "SELECT encounter_id, active_medication_count FROM features")
def active_intervals(spark, d):
    courses = testdata.medications(spark, d).selectExpr(
        "patient", "unix_micros(start) AS start", "unix_micros(stop) AS stop"
    )
    return timeline.active_count(
        _anchors(spark, d), courses, entity="patient", at="at", start="start", stop="stop", name="n"
    ).select("encounter_id", F.col("n").cast("int").alias("active_medication_count"))


@query("last_stay_before", "SELECT c.encounter_id, strftime(p.prev, '%Y-%m-%dT%H:%M:%SZ') AS prev_stop "
       "FROM cohort c LEFT JOIN priors p USING (encounter_id)")
def last_stay_before(spark, d):
    stays = _stays(spark, d).filter("encounter_class = 'inpatient'")
    return timeline.last_before(
        _anchors(spark, d), stays, entity="patient", at="at", name="prev"
    ).select("encounter_id", iso(F.timestamp_micros("prev")).alias("prev_stop"))


@query("readmitted_30d", "SELECT encounter_id FROM labelled WHERE label = 1")
def readmitted(spark, d):
    admissions = testdata.encounters(spark, d).filter("encounter_class = 'inpatient'").selectExpr(
        "patient", "unix_micros(start) AS at"
    )
    return timeline.forward_count(
        _anchors(spark, d), admissions, entity="patient", at="at", span=30 * DAY, name="n"
    ).filter("n > 0").select("encounter_id")


@query("history_flags", f"SELECT encounter_id, {', '.join(FLAGS)} FROM features")
def history_flags(spark, d):
    f = common.frames(spark, d)
    cohort = build_cohort(f["encounters"], f["patients"])
    return build_features(cohort, f["encounters"], f["medications"], f["conditions"]).select("encounter_id", *FLAGS)


@query("gap_clip", "SELECT encounter_id, days_since_prev_discharge FROM features")
def gap_clip(spark, d):
    from anchorline.functions.scalar import clip

    stays = _stays(spark, d).filter("encounter_class = 'inpatient'")
    anchors = anchor_rows(common.cohort(spark, d)).selectExpr(
        "encounter_id", "patient", "at", "unix_micros(start) AS admitted"
    )
    gap = (F.col("admitted") - F.col("prev")) / F.lit(float(DAY))
    return timeline.last_before(anchors, stays, entity="patient", at="at", name="prev").select(
        "encounter_id", clip(gap, 0, 365).alias("days_since_prev_discharge")
    )


@query("readable_encounters", """
SELECT e.id FROM encounters e WHERE EXISTS (SELECT 1 FROM cohort c WHERE c.patient_id = e.patient
  AND e.stop >= c.start - to_days(365) AND e.stop <= c.stop)""")
def readable_encounters(spark, d):
    f = common.frames(spark, d)
    return readable_rows(build_cohort(f["encounters"], f["patients"]), f, ("encounters",))["encounters"].select("id")


@query("readable_medications", """
SELECT encounter, code, count(*) AS n FROM medications m WHERE EXISTS (SELECT 1 FROM cohort c
  WHERE c.patient_id = m.patient AND m.start <= c.stop AND (m.stop IS NULL OR m.stop > c.stop)) GROUP BY 1, 2""")
def readable_medications(spark, d):
    f = common.frames(spark, d)
    rows = readable_rows(build_cohort(f["encounters"], f["patients"]), f, ("medications",))["medications"]
    return rows.groupBy("encounter", "code").agg(F.count("*").alias("n"))


@query("readable_conditions", """
SELECT encounter, code, count(*) AS n FROM conditions d WHERE EXISTS (SELECT 1 FROM cohort c
  WHERE c.patient_id = d.patient AND d.start <= CAST(c.stop AS DATE)) GROUP BY 1, 2""")
def readable_conditions(spark, d):
    f = common.frames(spark, d)
    rows = readable_rows(build_cohort(f["encounters"], f["patients"]), f, ("conditions",))["conditions"]
    return rows.groupBy("encounter", "code").agg(F.count("*").alias("n"))


# Every encounter is asked for; those the cohort does not admit give no row.
@query("serving_features", FEATURES_SQL)
def serving(spark, d):
    f = common.frames(spark, d)
    return serving_features(f, f["encounters"].select("id"))


# The event log: purchases are anchors, the clock is finer than a second.
PURCHASES = "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'"


def _activity(spark, d):
    log = testdata.activity(spark, d)
    return log.filter("event_type = 'purchase'").select("event_id", "entity", "at"), log


@query("activity_trailing", f"""
SELECT a.event_id, count(e.event_id) FILTER (WHERE e.event_type = 'click') AS clicks,
       count(e.event_id) FILTER (WHERE e.event_type = 'error') AS errors
FROM ({PURCHASES}) a LEFT JOIN events e
  ON e.user_id = a.user_id AND e.ts < a.ts AND e.ts >= a.ts - INTERVAL 3 DAY GROUP BY 1""")
def activity_trailing(spark, d):
    anchors, log = _activity(spark, d)
    return timeline.trailing_count(
        anchors, log, entity="entity", at="at", span=3 * DAY, slices=timeline.FINE,
        counts={"clicks": F.col("event_type") == "click", "errors": F.col("event_type") == "error"},
    ).select("event_id", "clicks", "errors")


@query("activity_last_before", f"""
SELECT a.event_id, max(epoch_us(e.ts)) AS previous FROM ({PURCHASES}) a LEFT JOIN events e
  ON e.user_id = a.user_id AND e.ts < a.ts AND e.event_type = 'purchase' GROUP BY 1""")
def activity_last(spark, d):
    anchors, _ = _activity(spark, d)
    return timeline.last_before(
        anchors, anchors, entity="entity", at="at", name="previous", slices=timeline.FINE
    ).select("event_id", "previous")


@query("activity_next", f"""
SELECT a.event_id, min(epoch_us(e.ts)) AS next_error FROM ({PURCHASES}) a LEFT JOIN events e
  ON e.user_id = a.user_id AND e.ts >= a.ts AND e.event_type = 'error' GROUP BY 1""")
def activity_next(spark, d):
    anchors, log = _activity(spark, d)
    return timeline.next_at_or_after(
        anchors, log.filter("event_type = 'error'"), entity="entity", at="at", name="next_error", slices=timeline.FINE
    ).select("event_id", "next_error")


@query("activity_label", f"""
SELECT a.event_id, CAST(count(e.event_id) > 0 AS INTEGER) AS label FROM ({PURCHASES}) a LEFT JOIN events e
  ON e.user_id = a.user_id AND e.ts > a.ts AND e.ts <= a.ts + INTERVAL 1 DAY AND e.event_type = 'error' GROUP BY 1""")
def activity_label(spark, d):
    anchors, log = _activity(spark, d)
    return timeline.forward_count(
        anchors, log.filter("event_type = 'error'"), entity="entity", at="at", span=DAY, name="n", slices=timeline.FINE
    ).selectExpr("event_id", "int(n > 0) AS label")


@query("activity_active", f"""
SELECT a.event_id, count(e.event_id) AS sessions FROM ({PURCHASES}) a LEFT JOIN events e
  ON e.user_id = a.user_id AND e.event_type = 'signup' AND e.ts <= a.ts AND e.ts + to_hours(CAST(floor(e.value) AS INTEGER)) > a.ts
GROUP BY 1""")
def activity_active(spark, d):
    anchors, log = _activity(spark, d)
    sessions = log.filter("event_type = 'signup'").selectExpr(
        "entity", "at AS start", "at + bigint(floor(value)) * 3600000000L AS stop"
    )
    return timeline.active_count(
        anchors, sessions, entity="entity", at="at", start="start", stop="stop", name="sessions", slices=timeline.FINE
    ).select("event_id", "sessions")
