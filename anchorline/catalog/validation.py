"""Contracts, quarantine and idempotent recording."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalog import common
from anchorline.catalog.anchors import ISO
from anchorline.catalog.registry import query
from anchorline.contracts import CONDITIONS, ENCOUNTERS, MEDICATIONS
from anchorline.functions.scalar import exact_format, iso
from anchorline.operators.order import event_stream
from anchorline.operators.upsert import compare_to_stored, first_per_key, mark_within_cap, record_batch
from anchorline.operators.validate import (
    registered_model, reversed_interval, shape_error, version_mismatches, with_errors,
)
from anchorline.plans.sanity import iso_valid
from anchorline.session import materialize
from anchorline.sources import testdata
from anchorline.sources.envelopes import parse_envelopes, write_envelopes
from anchorline.sources.raw import typed

TS = "'%Y-%m-%dT%H:%M:%SZ'"
# The text view of the encounters with faults planted by id.
FAULTY = f"""
, texts AS (SELECT id AS n, CAST(id AS VARCHAR) AS "Id", strftime(start, {TS}) AS s, coalesce(strftime(stop, {TS}), '') AS e,
                   CAST(patient AS VARCHAR) AS p, encounter_class AS k FROM encounters),
faulty AS (SELECT n, "Id",
  CASE WHEN n % 101 = 1 THEN replace(s, 'T', ' ') WHEN n % 113 = 5 THEN '2024-02-30T00:00:00Z'
       WHEN n % 103 = 2 AND e <> '' THEN e ELSE s END AS "START",
  CASE WHEN n % 103 = 2 AND e <> '' THEN s WHEN n % 89 = 6 THEN left(s, 10) ELSE e END AS "STOP",
  CASE WHEN n % 109 = 4 THEN '' ELSE p END AS "PATIENT",
  CASE WHEN n % 107 = 3 THEN '' ELSE k END AS "ENCOUNTERCLASS" FROM texts),
formed AS (SELECT *, coalesce(strftime(try_strptime("START", {TS}), {TS}) = "START", false) AS start_ok,
                  coalesce(strftime(try_strptime("STOP", {TS}), {TS}) = "STOP", false) AS stop_ok FROM faulty)
"""


def faulty(spark, d):
    """The faulty export, stored once per session: raw rows come from storage, not from an expression."""
    key = (spark.sparkContext.applicationId, d, "faulty")
    if key not in common._TABLES:
        common._TABLES[key] = materialize(_faulty(spark, d))
    return common._TABLES[key]


def _faulty(spark, d):
    raw = testdata.raw_population(spark, d)["encounters"].withColumn("n", F.col("Id").cast("long"))
    return raw.selectExpr(
        "Id",
        "CASE WHEN n % 101 = 1 THEN replace(START, 'T', ' ') WHEN n % 113 = 5 THEN '2024-02-30T00:00:00Z'"
        " WHEN n % 103 = 2 AND STOP <> '' THEN STOP ELSE START END AS START",
        "CASE WHEN n % 103 = 2 AND STOP <> '' THEN START WHEN n % 89 = 6 THEN left(START, 10) ELSE STOP END AS STOP",
        "if(n % 109 = 4, '', PATIENT) AS PATIENT",
        "if(n % 107 = 3, '', ENCOUNTERCLASS) AS ENCOUNTERCLASS",
    )


@query("typed_view", FAULTY + f"""
SELECT n AS encounter_id, CASE WHEN start_ok THEN "START" END AS start, CASE WHEN stop_ok THEN "STOP" END AS stop FROM formed""")
def typed_view(spark, d):
    return typed(faulty(spark, d), ENCOUNTERS).select(
        F.col("id").cast("long").alias("encounter_id"), iso("start").alias("start"), iso("stop").alias("stop")
    )


@query("exact_format", FAULTY + """
SELECT start_ok, "STOP" = '' AS open_stop, stop_ok, count(*) AS n FROM formed GROUP BY ALL""")
def formats(spark, d):
    pattern = ENCOUNTERS.time_pattern
    return faulty(spark, d).groupBy(
        exact_format(F.col("START"), pattern).alias("start_ok"), (F.col("STOP") == "").alias("open_stop"),
        exact_format(F.col("STOP"), pattern).alias("stop_ok"),
    ).agg(F.count("*").alias("n"))


@query("required_fields", FAULTY + """
SELECT count(*) FILTER (WHERE "PATIENT" = '') AS no_patient, count(*) FILTER (WHERE "ENCOUNTERCLASS" = '') AS no_class,
       count(*) FILTER (WHERE "Id" = '') AS no_id FROM faulty""")
def required(spark, d):
    return faulty(spark, d).agg(
        F.count_if(F.col("PATIENT") == "").alias("no_patient"),
        F.count_if(F.col("ENCOUNTERCLASS") == "").alias("no_class"), F.count_if(F.col("Id") == "").alias("no_id"),
    )


@query("interval_order", FAULTY + """
SELECT 'encounters' AS name, count(*) AS reversed FROM formed WHERE start_ok AND stop_ok AND "STOP" < "START"
UNION ALL SELECT 'medications', count(*) FROM medications WHERE stop < start
UNION ALL SELECT 'conditions', count(*) FROM conditions WHERE stop < start""")
def interval_order(spark, d):
    raw = testdata.raw_population(spark, d)
    parts = [("encounters", faulty(spark, d), ENCOUNTERS), ("medications", raw["medications"], MEDICATIONS),
             ("conditions", raw["conditions"], CONDITIONS)]
    out = None
    for name, df, contract in parts:
        row = df.agg(F.count_if(reversed_interval(contract)).alias("reversed")).select(F.lit(name).alias("name"), "reversed")
        out = row if out is None else out.unionByName(row)
    return out


ERRORS = """array_to_string(list_filter([
  CASE WHEN "PATIENT" = '' THEN 'empty:PATIENT' END, CASE WHEN "ENCOUNTERCLASS" = '' THEN 'empty:ENCOUNTERCLASS' END,
  CASE WHEN NOT start_ok THEN 'format:START' END, CASE WHEN "STOP" <> '' AND NOT stop_ok THEN 'format:STOP' END,
  CASE WHEN start_ok AND stop_ok AND "STOP" < "START" THEN 'interval:STOP' END], lambda x: x IS NOT NULL), ',')"""


@query("quarantine", FAULTY + f"""SELECT "Id" AS id, {ERRORS} AS errors FROM formed WHERE {ERRORS} <> ''""")
def quarantine(spark, d):
    return with_errors(faulty(spark, d), ENCOUNTERS).filter(F.size("errors") > 0).select(
        F.col("Id").alias("id"), F.concat_ws(",", "errors").alias("errors")
    )


@query("non_iso_timestamps", FAULTY + """
SELECT count(*) FILTER (WHERE "STOP" = '' OR "START" LIKE '2024-02-30%') AS unreadable FROM faulty""")
def non_iso(spark, d):
    return faulty(spark, d).agg(F.count_if(~(iso_valid(F.col("START")) & iso_valid(F.col("STOP")))).alias("unreadable"))


@query("contract_projection", f"""
SELECT CAST(id AS VARCHAR) AS "Id", {ISO.format('start')} AS "START", coalesce({ISO.format('stop')}, '') AS "STOP",
       CAST(patient AS VARCHAR) AS "PATIENT", encounter_class AS "ENCOUNTERCLASS" FROM encounters""")
def contract_projection(spark, d):
    return testdata.raw_population(spark, d)["encounters"].select(*ENCOUNTERS.payload)


@query("envelope_source", """
SELECT 'patient' AS kind, true AS accepted, count(*) AS events FROM patients UNION ALL SELECT 'encounter', true, count(*) FROM encounters
UNION ALL SELECT 'medication', true, count(*) FROM medications UNION ALL SELECT 'condition', true, count(*) FROM conditions""")
def envelope_source(spark, d):
    parsed = parse_envelopes(write_envelopes(testdata.raw_population(spark, d)))
    return parsed.groupBy("kind", (F.size("errors") == 0).alias("accepted")).agg(F.count("*").alias("events"))


# Lines with planted shape faults: an extra field, a missing field, a number for text, broken JSON.
@query("envelope_shapes", """
SELECT CASE WHEN id % 10 IN (1, 2, 3) THEN 'wrong_fields' WHEN id % 10 = 4 THEN 'malformed_json'
            WHEN id % 10 = 5 THEN 'unknown_kind' ELSE 'ok' END AS shape, count(*) AS n FROM encounters GROUP BY 1""")
def envelope_shapes(spark, d):
    raw = testdata.raw_population(spark, d)
    lines = write_envelopes({"encounters": raw["encounters"]})
    n = F.get_json_object("value", "$.payload.Id").cast("long") % 10
    damaged = lines.select(
        F.when(n == 1, F.expr("replace(value, '\"Id\":', '\"X\":\"1\",\"Id\":')"))
        .when(n == 2, F.expr("regexp_replace(value, '\"STOP\":\"[^\"]*\"', '\"STAY\":\"\"')"))
        .when(n == 3, F.expr("regexp_replace(value, '\"PATIENT\":\"([0-9]+)\"', '\"PATIENT\":$1')"))
        .when(n == 4, F.expr("left(value, length(value) - 1)"))
        .when(n == 5, F.expr("replace(value, '\"encounter\"', '\"visit\"')"))
        .otherwise(F.col("value")).alias("value")
    )
    return damaged.groupBy(F.coalesce(shape_error(F.col("value")), F.lit("ok")).alias("shape")).agg(F.count("*").alias("n"))


# Line items repeat (order, line) keys with different contents: arrivals that contradict each other.
SEQ = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
ARRIVALS = """
, arrivals AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate, l_partkey, l_suppkey, l_extendedprice,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn
    FROM lineitem)
"""


def _arrivals(spark, d):
    return testdata.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", *SEQ)


@query("natural_key_dedup", ARRIVALS + """
SELECT l_orderkey, l_linenumber, max(l_quantity) FILTER (WHERE rn = 1) AS l_quantity, count(*) AS copies,
       count(DISTINCT (l_quantity, l_returnflag)) > 1 AS conflicting FROM arrivals GROUP BY 1, 2""")
def natural_key_dedup(spark, d):
    return first_per_key(_arrivals(spark, d), ["l_orderkey", "l_linenumber"], SEQ).select(
        "l_orderkey", "l_linenumber", "l_quantity", "copies", "conflicting"
    )


SIDES = ARRIVALS + """
, stored AS (SELECT l_orderkey, l_linenumber, arg_min(l_quantity, rn) AS l_quantity, arg_min(l_returnflag, rn) AS l_returnflag
             FROM arrivals WHERE l_suppkey % 2 = 0 GROUP BY 1, 2),
incoming AS (SELECT l_orderkey, l_linenumber, arg_min(l_quantity, rn) AS l_quantity, arg_min(l_returnflag, rn) AS l_returnflag
             FROM arrivals WHERE l_suppkey % 2 = 1 GROUP BY 1, 2),
compared AS (SELECT i.*, s.l_orderkey IS NULL AS fresh, i.l_quantity IS DISTINCT FROM s.l_quantity AS dq,
                    i.l_returnflag IS DISTINCT FROM s.l_returnflag AS dr
             FROM incoming i LEFT JOIN stored s USING (l_orderkey, l_linenumber))
"""
KEY = ["l_orderkey", "l_linenumber"]


def _sides(spark, d):
    rows = _arrivals(spark, d)
    first = lambda p: first_per_key(rows.filter(p), KEY, SEQ).select(*KEY, "l_quantity", "l_returnflag")
    return first("l_suppkey % 2 = 1"), first("l_suppkey % 2 = 0")


@query("key_conflicts", SIDES + """
SELECT l_orderkey, l_linenumber, CASE WHEN dq AND dr THEN 'l_quantity,l_returnflag' WHEN dq THEN 'l_quantity'
       ELSE 'l_returnflag' END AS differing FROM compared WHERE NOT fresh AND (dq OR dr)""")
def key_conflicts(spark, d):
    incoming, stored = _sides(spark, d)
    return compare_to_stored(incoming, stored, KEY).filter("status = 'conflict'").select(
        *KEY, F.concat_ws(",", "differing").alias("differing")
    )


@query("upsert_rows", SIDES + """
SELECT CASE WHEN fresh THEN 'new' WHEN dq OR dr THEN 'conflict' ELSE 'duplicate' END AS status, count(*) AS n
FROM compared GROUP BY 1""")
def upsert_rows(spark, d):
    incoming, stored = _sides(spark, d)
    return compare_to_stored(incoming, stored, KEY).groupBy("status").agg(F.count("*").alias("n"))


@query("upsert_batch", SIDES + """
, firsts AS (SELECT l_orderkey, l_linenumber, arg_min(l_quantity, rn) AS q, arg_min(l_returnflag, rn) AS r
             FROM arrivals WHERE l_suppkey % 2 = 1 GROUP BY 1, 2),
known AS (SELECT coalesce(s.l_orderkey, f.l_orderkey) AS o, coalesce(s.l_linenumber, f.l_linenumber) AS l,
                 CASE WHEN s.l_orderkey IS NULL THEN f.q ELSE s.l_quantity END AS q,
                 CASE WHEN s.l_orderkey IS NULL THEN f.r ELSE s.l_returnflag END AS r
          FROM stored s FULL JOIN firsts f USING (l_orderkey, l_linenumber))
SELECT 'new' AS part, count(*) AS n FROM firsts ANTI JOIN stored USING (l_orderkey, l_linenumber)
UNION ALL SELECT 'conflict', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_returnflag
  FROM arrivals JOIN known ON o = l_orderkey AND l = l_linenumber
  WHERE l_suppkey % 2 = 1 AND (l_quantity <> q OR l_returnflag <> r))""")
def upsert_batch(spark, d):
    _, stored = _sides(spark, d)
    new, conflicts = record_batch(_arrivals(spark, d).filter("l_suppkey % 2 = 1"), stored, KEY, SEQ)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(new, "new").unionByName(count(conflicts, "conflict"))


EVENTS = f"""
, stream AS (
  SELECT coalesce({ISO.format('stop')}, 'open:' || {ISO.format('start')}) AS "at", 2 AS kind_order, 'encounter' AS kind,
         patient AS entity,
         concat_ws(chr(31), 'ENCOUNTERCLASS=' || encounter_class, 'Id=' || id, 'PATIENT=' || patient,
                   'START=' || {ISO.format('start')}, 'STOP=' || coalesce({ISO.format('stop')}, '')) AS row_key
  FROM encounters
  UNION ALL SELECT {ISO.format('start')}, 0, 'medication', patient,
         concat_ws(chr(31), 'CODE=' || code, 'ENCOUNTER=' || encounter, 'PATIENT=' || patient,
                   'START=' || {ISO.format('start')}, 'STOP=' || coalesce({ISO.format('stop')}, '')) FROM medications
  UNION ALL SELECT start || 'T00:00:00Z', 1, 'condition', patient,
         concat_ws(chr(31), 'CODE=' || code, 'DESCRIPTION=' || description, 'ENCOUNTER=' || encounter,
                   'PATIENT=' || patient, 'START=' || start, 'STOP=' || coalesce(CAST(stop AS VARCHAR), ''),
                   'SYSTEM=' || system) FROM conditions)
"""


@query("entity_row_cap", EVENTS + """
SELECT CAST(entity AS VARCHAR) AS entity, count(*) FILTER (WHERE rn <= 60) AS accepted, count(*) FILTER (WHERE rn > 60) AS refused,
       max("at") FILTER (WHERE rn <= 60) AS last_accepted
FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY "at", kind_order, row_key) AS rn FROM stream) GROUP BY 1""")
def entity_row_cap(spark, d):
    events = event_stream(testdata.raw_population(spark, d)).drop("payload")
    marked = mark_within_cap(events, entity="entity", order=["at", "kind_order", "row_key"], limit=60)
    return marked.groupBy("entity").agg(
        F.count_if("fits").alias("accepted"), F.count_if(~F.col("fits")).alias("refused"),
        F.max(F.when(F.col("fits"), F.col("at"))).alias("last_accepted"),
    )


@query("registered_models", """
SELECT p_partkey, regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') AND version > 0 AS usable
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE replace(p_type, ' ', '-') END AS name, p_size - 5 AS version FROM part)""")
def registered_models(spark, d):
    parts = testdata.table(spark, d, "part").selectExpr(
        "p_partkey", "if(p_partkey % 3 = 0, p_brand, replace(p_type, ' ', '-')) AS name", "p_size - 5 AS version"
    )
    return parts.select("p_partkey", registered_model(F.col("name"), F.col("version")).alias("usable"))


@query("version_mismatches", """
, logged AS (SELECT DISTINCT 'signal_' || p_size AS signal, (p_size % 3) || '.' || (p_size % 4) || CASE WHEN p_size % 5 = 0 THEN '' ELSE '.7' END AS version
             FROM part WHERE p_size % 7 <> 0),
required AS (SELECT DISTINCT 'signal_' || p_size AS signal, '1.2.0' AS running FROM part)
SELECT signal, version AS pinned, running FROM required LEFT JOIN logged USING (signal)
WHERE NOT coalesce(regexp_full_match(version, '[0-9]+\\.[0-9]+\\.[0-9]+') AND split_part(version, '.', 1) = '1'
                   AND split_part(version, '.', 2) = '2', false)""")
def mismatched_versions(spark, d):
    parts = testdata.table(spark, d, "part")
    logged = parts.filter("p_size % 7 <> 0").selectExpr(
        "concat('signal_', p_size) AS signal",
        "concat(p_size % 3, '.', p_size % 4, if(p_size % 5 = 0, '', '.7')) AS version",
    ).distinct()
    required = parts.selectExpr("concat('signal_', p_size) AS signal", "'1.2.0' AS running").distinct()
    return version_mismatches(logged, required)
