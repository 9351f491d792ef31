import hashlib
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from anchorline.contracts import CONDITIONS, ENCOUNTERS, MEDICATIONS, PATIENTS
from anchorline.functions.hashing import REKEY_NAMESPACE, payload_hash, rekey
from anchorline.functions.stats import kolmogorov_p, normal_sf
from anchorline.functions.ulps import ulp_distance
from anchorline.operators.joins import keyed_difference, table_difference
from anchorline.operators.upsert import cap_per_entity, compare_to_stored, first_per_key, record_batch
from anchorline.operators.validate import registered_model, shape_error, split_valid, version_mismatches, with_errors
from anchorline.plans.sanity import crude_readmission_rate, population_stats
from anchorline.sources.envelopes import parse_envelopes, write_envelopes
from anchorline.sources.manifest import build_manifest, verify_manifest
from anchorline.sources.raw import load_population, rekeyed


def errors(spark, contract, **row):
    base = dict.fromkeys(contract.payload, "x")
    base.update({c: "2024-01-01T00:00:00Z" if contract.time_pattern.endswith("'Z'") else "2024-01-01"
                 for c in (*contract.required_times, *contract.optional_times)})
    base.update(row)
    df = spark.createDataFrame([tuple(base[c] for c in contract.payload)], contract.payload_schema)
    return with_errors(df, contract).first()["errors"]


def test_every_reason_is_reported(spark):
    assert errors(spark, ENCOUNTERS) == []
    assert errors(spark, ENCOUNTERS, STOP="") == []
    assert errors(spark, ENCOUNTERS, PATIENT="", START="2024-1-1T00:00:00Z", STOP="soon") == ["empty:PATIENT", "format:START", "format:STOP"]
    assert errors(spark, ENCOUNTERS, START="2024-01-02T00:00:00Z") == ["interval:STOP"]
    assert errors(spark, CONDITIONS, START="2024-01-02") == ["interval:STOP"]
    assert errors(spark, MEDICATIONS, START="2024-01-02T00:00:00Z") == []
    assert errors(spark, PATIENTS, DEATHDATE="") == [] and errors(spark, PATIENTS, BIRTHDATE="") == ["format:BIRTHDATE"]
    assert errors(spark, CONDITIONS, DESCRIPTION="a\x01b") == ["control:DESCRIPTION"]
    good, bad = split_valid(spark.createDataFrame([("p", "2000-01-01", None), ("", "2000-01-01", "")], PATIENTS.payload_schema), PATIENTS)
    assert good.count() == 1 and bad.count() == 1


@pytest.mark.parametrize("line, want", [
    ('{"event_type":"patient","payload":{"Id":"p","BIRTHDATE":"2000-01-01","DEATHDATE":""}}', None),
    ('{"payload":{"DEATHDATE":"","BIRTHDATE":"2000-01-01","Id":"p"},"event_type":"patient"}', None),
    ('{"event_type":"patient","payload":{"Id":"p","BIRTHDATE":"2000-01-01","DEATHDATE":"","GENDER":"F"}}', "wrong_fields"),
    ('{"event_type":"patient","payload":{"Id":"p","BIRTHDATE":"2000-01-01"}}', "wrong_fields"),
    ('{"event_type":"patient","payload":{"Id":7,"BIRTHDATE":"2000-01-01","DEATHDATE":""}}', "wrong_fields"),
    ('{"event_type":"patient","payload":{"Id":"p","BIRTHDATE":"2000-01-01","DEATHDATE":""},"more":1}', "wrong_fields"),
    ('{"event_type":"visit","payload":{}}', "unknown_kind"), ('{"event_type":', "malformed_json"), ("[]", "unknown_kind"),
])
def test_envelope_shape(spark, line, want):
    assert spark.createDataFrame([(line,)], "value STRING").select(shape_error(F.col("value"))).first()[0] == want


def test_payload_hash_is_canonical_json(spark, population):
    texts = ['plain', 'quo"te', "back\\slash", "tab\tnewline\n", "Zoë 東京 🙂", "a/b", " "]
    rows = [(t, "2024-01-01T00:00:00Z", "", "p", "inpatient") for t in texts]
    df = spark.createDataFrame(rows, ENCOUNTERS.payload_schema)
    got = [r[0] for r in df.select(payload_hash("encounter", {c: F.col(c) for c in ENCOUNTERS.payload})).collect()]
    for row, digest in zip(rows, got):
        event = {"event_type": "encounter", "payload": dict(zip(ENCOUNTERS.payload, row))}
        text = json.dumps(event, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert digest == hashlib.sha256(text.encode()).hexdigest()


def test_rekey_is_uuid5(spark):
    ids = ["", "a", "7c1e", "Zoë"]
    df = spark.createDataFrame([(i,) for i in ids], "id STRING")
    got = [r[0] for r in df.select(rekey("pop", F.col("id"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(REKEY_NAMESPACE), f"pop/{i}")) if i else "" for i in ids]


def test_rekeyed_keeps_joins_and_other_columns(spark, population):
    raw = population.patient("p").stay("e", "p", "2024-01-01T00:00:00Z", "").course("p", "2024-01-01T00:00:00Z", encounter="e").raw(spark)
    new = rekeyed(raw, "other")
    stay, course, person = new["encounters"].first(), new["medications"].first(), new["patients"].first()
    assert stay["PATIENT"] == person["Id"] == course["PATIENT"] != "p"
    assert stay["Id"] == course["ENCOUNTER"] and stay["START"] == "2024-01-01T00:00:00Z" and course["CODE"] == "m1"


def test_first_arrival_stands(spark):
    rows = [("k", 1, "a"), ("k", 2, "b"), ("d", 3, "x"), ("d", 4, "x"), ("s", 5, "y")]
    df = spark.createDataFrame(rows, "key STRING, seq INT, v STRING")
    got = {r["key"]: (r["v"], r["copies"], r["conflicting"]) for r in first_per_key(df, ["key"], ["seq"]).collect()}
    assert got == {"k": ("a", 2, True), "d": ("x", 2, False), "s": ("y", 1, False)}


def test_recording_a_batch(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1")], "key STRING, v STRING")
    incoming = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("c", "3", 3), ("c", "4", 4), ("c", "3", 5)], "key STRING, v STRING, seq INT")
    new, conflicts = record_batch(incoming, stored, ["key"], ["seq"])
    assert [(r["key"], r["v"]) for r in new.collect()] == [("c", "3")]
    assert {(r["key"], r["v"], tuple(r["differing"])) for r in conflicts.collect()} == {("b", "2", ("v",)), ("c", "4", ("v",))}
    status = {r["key"]: r["status"] for r in compare_to_stored(incoming.filter("seq < 4").drop("seq"), stored, ["key"]).collect()}
    assert status == {"a": "duplicate", "b": "conflict", "c": "new"}


def test_row_cap_counts_held_rows(spark):
    events = spark.createDataFrame([("p", i) for i in range(10)] + [("q", 1)], "entity STRING, seq INT")
    held = spark.createDataFrame([("p", 4)], "entity STRING, rows INT")
    accepted, refused = cap_per_entity(events, entity="entity", order=["seq"], limit=7, held=held)
    assert {(r[0], r[1]) for r in accepted.collect()} == {("p", 0), ("p", 1), ("p", 2), ("q", 1)}
    assert sorted(r["seq"] for r in refused.collect()) == list(range(3, 10))


@pytest.mark.parametrize("limit", [0, 1, 7, 50])
def test_row_cap_equals_brute_force(spark, limit):
    draw = random.Random(limit)
    ats = ["", None, "open:2024-01-01T00:00:00Z", *[f"2024-01-{d:02d}T0{h}:00:00Z" for d in range(1, 9) for h in range(3)]]
    rows = [(draw.choice("pqr"), draw.choice(ats), draw.randrange(3), n) for n in range(200)]
    events = spark.createDataFrame(rows, "entity STRING, at STRING, kind INT, n INT")
    held = spark.createDataFrame([("p", 4), ("z", 9)], "entity STRING, rows INT")
    accepted, refused = cap_per_entity(events, entity="entity", order=["at", "kind", "n"], limit=limit, held=held)
    want = set()
    for e in "pqr":
        own = sorted((r for r in rows if r[0] == e), key=lambda r: (r[1] is not None, r[1] or "", r[2], r[3]))
        want |= {r[3] for r in own[: max(0, limit - (4 if e == "p" else 0))]}
    assert {r["n"] for r in accepted.collect()} == want
    assert {r["n"] for r in refused.collect()} == {r[3] for r in rows} - want
    by_number, _ = cap_per_entity(events.select("entity", "n"), entity="entity", order=["n"], limit=limit)
    assert by_number.count() == sum(min(limit, sum(r[0] == e for r in rows)) for e in "pqr")


def test_table_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k INT, v STRING")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k INT, v STRING")
    assert table_difference(a, a).isEmpty()
    assert {tuple(r) for r in table_difference(a, b).collect()} == {(2, "y", 2, 1), (3, None, 0, 1)}
    got = {r["k"]: r["differences"] for r in keyed_difference(a.distinct(), b.replace("x", "z"), ["k"]).collect()}
    assert got == {1: ["v"], 3: ["missing_left"]}


def test_versions_and_model_names(spark):
    logged = spark.createDataFrame([("f", "1.1.9"), ("c", "1.2.0"), ("l", "1.0")], "signal STRING, version STRING")
    required = spark.createDataFrame([("f", "1.1.0"), ("c", "1.1.0"), ("l", "1.0.0"), ("gone", "1.0.0")], "signal STRING, running STRING")
    assert {r["signal"] for r in version_mismatches(logged, required).collect()} == {"c", "l", "gone"}
    names = [("ok-name_1.2", 1, True), ("-bad", 1, False), ("a/b", 1, False), ("a" * 129, 1, False), ("a", 0, False), (None, 1, False)]
    df = spark.createDataFrame(names, "n STRING, v INT, want BOOLEAN")
    assert all(r[0] == r[1] for r in df.select(registered_model(F.col("n"), F.col("v")), "want").collect())


def test_ulps(spark):
    x = 0.1
    df = spark.createDataFrame([(x, x, 0), (x, 0.10000000000000002, 1), (-5e-324, 5e-324, 2), (0.0, 1.0, 1000)], "a DOUBLE, b DOUBLE, n INT")
    assert all(r[0] == r[1] for r in df.select(ulp_distance(F.col("a"), F.col("b")), "n").collect())


def test_closed_forms(spark):
    df = spark.createDataFrame([(1.959964, 0.025), (0.0, 0.5), (3.0, 0.0013499)], "z DOUBLE, p DOUBLE")
    assert all(r[0] == pytest.approx(r[1], abs=1e-6) for r in df.select(normal_sf(F.col("z")), "p").collect())
    k = spark.createDataFrame([(0.0, 10, 10), (1.0, 1000, 1000), (0.0608, 1000, 1000)], "d DOUBLE, n INT, m INT")
    p = [r[0] for r in k.select(kolmogorov_p(F.col("d"), F.col("n"), F.col("m"))).collect()]
    assert p[0] == 1.0 and p[1] < 1e-100 and p[2] == pytest.approx(0.0494, abs=1e-3)


def test_csv_scan_is_verbatim(spark, tmp_path):
    (tmp_path / "conditions.csv").write_text(
        'START,STOP,PATIENT,ENCOUNTER,SYSTEM,CODE,DESCRIPTION\n2024-01-01,,007,NA,S,0012,"say ""hi"", ok (disorder)"\n'
    )
    row = load_population(spark, str(tmp_path), frames=("conditions",))["conditions"].first()
    assert (row["STOP"], row["PATIENT"], row["ENCOUNTER"], row["CODE"]) == ("", "007", "NA", "0012")
    assert row["DESCRIPTION"] == 'say "hi", ok (disorder)'
    with pytest.raises(ValueError, match="allergies"):
        load_population(spark, str(tmp_path), frames=("allergies",))


def test_line_breaks_in_cells_are_read_where_they_are_asked_for(spark, tmp_path):
    (tmp_path / "conditions.csv").write_text(
        'START,STOP,PATIENT,ENCOUNTER,SYSTEM,CODE,DESCRIPTION\n2024-01-01,,p,e,S,1,"two\nlines"\n2024-01-02,,p,e,S,2,one\n'
    )
    ask = lambda **more: load_population(spark, str(tmp_path), frames=("conditions",), **more)["conditions"]
    assert {r["DESCRIPTION"] for r in ask(line_breaks=True).collect()} == {"two\nlines", "one"}
    # A torn row has too few cells, and is not passed over.
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        ask().collect()


def test_manifest_lists_every_discrepancy(spark, tmp_path):
    for name, text in (("a.csv", "h\n1\n2\n"), ("b.csv", "h\n"), ("c.csv", "")):
        (tmp_path / name).write_text(text)
    (tmp_path / "note.txt").write_text("x")
    first = build_manifest(spark, str(tmp_path))
    rows = {r["path"]: r for r in first.collect()}
    assert {k: (r["bytes"], r["rows"]) for k, r in rows.items()} == {"a.csv": (6, 2), "b.csv": (2, 0), "c.csv": (0, 0)}
    assert rows["a.csv"]["sha256"] == hashlib.sha256(b"h\n1\n2\n").hexdigest()
    kept = spark.createDataFrame(first.collect(), first.schema)
    (tmp_path / "a.csv").write_text("h\n9\n2\n")
    (tmp_path / "b.csv").rename(tmp_path / "d.csv")
    got = {(r["path"], r["problem"]) for r in verify_manifest(kept, build_manifest(spark, str(tmp_path))).collect()}
    assert got == {("a.csv", "checksum mismatch"), ("b.csv", "missing file"), ("d.csv", "extra file")}


def test_envelopes_round_trip(spark, population):
    population.patient("p").stay("e", "p", "2024-01-01T00:00:00Z", "").diagnosis("p", "2024-01-01").course("p", "2024-01-01T00:00:00Z")
    got = {r["kind"]: r for r in parse_envelopes(write_envelopes(population.raw(spark))).collect()}
    assert all(r["errors"] == [] and r["entity"] == "p" for r in got.values())
    assert got["encounter"]["at"] == "open:2024-01-01T00:00:00Z"
    assert got["condition"]["at"] == got["medication"]["at"] == "2024-01-01T00:00:00Z"
    assert got["encounter"]["input_hash"] != got["patient"]["input_hash"]


def test_sanity_statistics(spark, population):
    population.patient("a", "1990-01-01").patient("b", "2020-01-01")
    population.stay("1", "a", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z").stay("2", "a", "2024-02-01T00:00:00Z", "2024-02-02T00:00:00Z")
    population.stay("3", "b", "2024-01-01T00:00:00Z", "").stay("4", "b", "2023-01-01T00:00:00Z", "2023-01-02T00:00:00Z", "wellness")
    raw, f = population.raw(spark), population.typed(spark)
    row = population_stats(raw["patients"], raw["encounters"], "2024-06-01").first()
    assert (row["total_patients"], row["total_encounters"], row["inpatient_encounters"], row["adult_share"]) == (2, 4, 2, 0.5)
    assert (row["first_start"], row["invalid_timestamp_rows"]) == ("2023-01-01T00:00:00Z", 1)
    assert crude_readmission_rate(f["encounters"]).first()["readmitted"] == 1


def test_a_line_is_parsed_once_whatever_reads_it(spark):
    accepted = parse_envelopes(spark.createDataFrame([("{}",)], "value STRING")).filter(F.size("errors") == 0)
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_lines_that_are_not_canonical_are_looked_at_field_by_field(spark):
    row = {"Id": "p", "BIRTHDATE": "2000-01-01", "DEATHDATE": ""}
    lacking = {k: v for k, v in row.items() if k != "DEATHDATE"}
    tight = lambda payload, **more: json.dumps({"event_type": "patient", "payload": payload, **more}, sort_keys=True, separators=(",", ":"))
    spaced = json.dumps({"payload": row, "event_type": "patient"})
    lines = {
        tight(row): [], spaced: [], tight({**row, "BIRTHDATE": ""}): ["format:BIRTHDATE"], tight(lacking): ["wrong_fields"],
        tight({**row, "DEATHDATE": None}): ["wrong_fields"], tight({**row, "DEATHDATE": 3}): ["wrong_fields"],
        tight({**row, "X": ""}): ["wrong_fields"], tight(row, x="1"): ["wrong_fields"], "[": ["malformed_json"], "{}": ["unknown_kind"],
    }
    got = {r["value"]: r for r in parse_envelopes(spark.createDataFrame([(v,) for v in lines], "value STRING")).collect()}
    assert {v: r["errors"] for v, r in got.items()} == lines
    assert got[tight(row)]["input_hash"] == got[spaced]["input_hash"] == hashlib.sha256(tight(row).encode()).hexdigest()


def test_the_row_cap_does_not_sort_events_to_look_up_their_limit(spark):
    from anchorline.operators.upsert import mark_within_cap

    events = spark.range(100).selectExpr("id % 3 AS entity", "string(id) AS at")
    plan = mark_within_cap(events, entity="entity", order=["at"], limit=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=shuffle_hash") == 2
