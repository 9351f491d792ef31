"""Stream order, cursors, splices."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalog import common
from anchorline.catalog.anchors import ISO
from anchorline.catalog.registry import query
from anchorline.catalog.validation import EVENTS
from anchorline.functions.scalar import iso
from anchorline.operators import order
from anchorline.operators.rank import with_row_number
from anchorline.plans.labels import schedule_of
from anchorline.sources import testdata

NOW = "1998-06-01T00:00:00Z"


def stream(spark, d):
    return order.event_stream(testdata.raw_population(spark, d)).drop("payload")


@query("events_by_kind", EVENTS + "SELECT kind, count(*) AS events FROM stream GROUP BY 1")
def events_by_kind(spark, d):
    return stream(spark, d).groupBy("kind").agg(F.count("*").alias("events"))


@query("stream_projection", EVENTS + "SELECT \"at\", kind, CAST(entity AS VARCHAR) AS entity FROM stream")
def stream_projection(spark, d):
    return stream(spark, d).select("at", "kind", "entity")


@query("stream_order", EVENTS + """
SELECT row_number() OVER (ORDER BY "at", kind_order, row_key) AS seq, "at", kind, row_key FROM stream""")
def stream_order(spark, d):
    return order.with_sequence(stream(spark, d)).select("seq", "at", "kind", "row_key")


@query("arrival_times", EVENTS + """
SELECT kind, "at" LIKE 'open:%' AS open, min("at") AS first_at, max("at") AS last_at FROM stream GROUP BY ALL""")
def arrival_times(spark, d):
    return stream(spark, d).groupBy("kind", F.col("at").startswith("open:").alias("open")).agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )


@query("history_and_replay", EVENTS + f"""
SELECT CASE WHEN "at" < '{NOW}' THEN 'history' ELSE 'replay' END AS part, kind, count(*) AS events FROM stream GROUP BY ALL""")
def history_and_replay(spark, d):
    events = stream(spark, d)
    count = lambda df, name: df.groupBy("kind").agg(F.count("*").alias("events")).withColumn("part", F.lit(name))
    return count(order.history_before(events, NOW), "history").unionByName(count(order.replay_from(events, NOW), "replay"))


@query("due_events", EVENTS + f"""
SELECT "at", kind, row_key FROM stream WHERE ("at", kind_order, row_key) > ('1998-05-01T00:00:00Z', 1, '') AND "at" <= '{NOW}'""")
def due_events(spark, d):
    return order.due_after(stream(spark, d), ("1998-05-01T00:00:00Z", 1, ""), NOW).select("at", "kind", "row_key")


@query("merge_labels_and_events", f"""
, sched AS (SELECT {ISO.format('stop + to_days(30)')} AS "at", encounter_id AS idx FROM cohort),
arrivals AS (SELECT {ISO.format('stop')} AS "at", id AS idx FROM encounters WHERE stop IS NOT NULL)
SELECT "at", side, idx, row_number() OVER (ORDER BY "at", side, idx) AS position
FROM (SELECT "at", 0 AS side, idx FROM sched UNION ALL SELECT "at", 1, idx FROM arrivals)""")
def merged(spark, d):
    due = common.cohort(spark, d).selectExpr("date_format(stop + INTERVAL 30 DAYS, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS at", "encounter_id AS idx")
    arrivals = testdata.encounters(spark, d).filter("stop IS NOT NULL").select(iso("stop").alias("at"), F.col("id").alias("idx"))
    return order.merge_by_instant(due, arrivals)


SPLICES = (("1997-01-01T00:00:00Z", "even"), ("1998-01-01T00:00:00Z", "odd"), ("1999-01-01T00:00:00Z", "even"))
OWNED = """((population = 'even' AND (("at" >= '1997-01-01T00:00:00Z' AND "at" < '1998-01-01T00:00:00Z') OR "at" >= '1999-01-01T00:00:00Z'))
  OR (population = 'odd' AND "at" >= '1998-01-01T00:00:00Z' AND "at" < '1999-01-01T00:00:00Z'))"""


@query("segment_ownership", EVENTS + f"""
SELECT population, kind, count(*) AS events FROM (SELECT *, CASE WHEN entity % 2 = 0 THEN 'even' ELSE 'odd' END AS population FROM stream)
WHERE {OWNED} GROUP BY ALL""")
def segment_ownership(spark, d):
    events = stream(spark, d).withColumn("population", F.expr("if(bigint(entity) % 2 = 0, 'even', 'odd')"))
    return events.filter(F.col("population") == order.owner(SPLICES, F.col("at"))).groupBy("population", "kind").agg(F.count("*").alias("events"))


@query("spliced_stream", EVENTS + f"""
SELECT population, "at", kind, row_key, row_number() OVER (ORDER BY "at", kind_order, row_key) AS seq
FROM (SELECT *, CASE WHEN entity % 2 = 0 THEN 'even' ELSE 'odd' END AS population FROM stream) WHERE {OWNED}""")
def spliced_stream(spark, d):
    events = stream(spark, d)
    parts = {"even": events.filter("bigint(entity) % 2 = 0"), "odd": events.filter("bigint(entity) % 2 = 1")}
    return order.with_sequence(order.spliced(parts, SPLICES)).select("population", "at", "kind", "row_key", "seq")


@query("spliced_labels", f"""
, sched AS (SELECT CASE WHEN patient_id % 2 = 0 THEN 'even' ELSE 'odd' END AS population,
   {ISO.format('stop + to_days(30)')} AS due_at, encounter_id, {ISO.format('stop')} AS "at", label FROM cohort JOIN labelled USING (encounter_id))
SELECT due_at, encounter_id, "at" AS discharged_at, label, row_number() OVER (ORDER BY due_at, encounter_id) AS position
FROM sched WHERE {OWNED}""")
def spliced_labels(spark, d):
    rows = common.scored(spark, d)
    plan = lambda p: schedule_of(rows.select("encounter_id", "label"), rows.filter(p))
    parts = {"even": plan("patient_id % 2 = 0"), "odd": plan("patient_id % 2 = 1")}
    owned = order.spliced(parts, SPLICES, at="discharged_at").drop("population")
    return with_row_number(owned, ["due_at", "encounter_id"], "position")
