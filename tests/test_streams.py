import hashlib
import json

import pytest
from tables import SMALL, by_id
from pyspark.sql import Row, functions as F
from test_features import random_population

from anchorline.contracts import FEATURE_COLUMNS, MODEL_INPUTS
from anchorline.operators import order
from anchorline.plans import audit
from anchorline.plans.cohort import build_cohort
from anchorline.plans.features import build_features
from anchorline.plans.labels import label_schedule
from anchorline.sources import testdata
from anchorline.sources.envelopes import parse_envelopes, stream_lines, write_envelopes
from anchorline.sources.logs import (
    EventStore, LabelLog, PredictionLog, ReferenceExists, ReferenceStore, UnscoredDischarge, logged_features, preload,
)
from anchorline.streaming import ingest as arrival
from anchorline.streaming import monitoring, release


@pytest.fixture
def run(spark, tmp_path):
    """Feed files of event lines, in order, through the stream; outcomes so far."""
    arrival.use_state_store(spark)
    source, out, check = (str(tmp_path / n) for n in ("lines", "out", "check"))

    def go(*batches, per_trigger=None, **options):
        for lines in batches:
            lines.coalesce(1).write.mode("append").text(source)
        monitoring.run_available(arrival.ingest(stream_lines(spark, source, per_trigger), **options), check, path=out)
        return spark.read.parquet(out)

    return go


def batch_features(spark, population):
    f = population.typed(spark)
    return build_features(build_cohort(f["encounters"], f["patients"]), f["encounters"], f["medications"], f["conditions"])


def slices(raw, cuts):
    """Event lines of the population in arrival order, demographics first, cut into files."""
    edges = ["", *cuts, "~"]
    arrive = {"encounters": "encounter", "medications": "medication", "conditions": "condition"}
    for low, high in zip(edges, edges[1:]):
        part = {n: raw[n].filter((order.arrival(k) >= low) & (order.arrival(k) < high)) for n, k in arrive.items()}
        yield write_envelopes({**({"patients": raw["patients"]} if low == "" else {}), **part})


def test_stream_equals_batch_across_files_and_restarts(spark, population, run):
    random_population(population, 11, patients=6)
    population.rows["conditions"] = list({(r["PATIENT"], r["ENCOUNTER"], r["CODE"], r["START"]): r for r in population.rows["conditions"]}.values())
    raw = population.raw(spark)
    files = list(slices(raw, ["2022-09-01", "2023-06-01"]))
    run(files[0])  # stopped here, resumed on the same checkpoint
    outcomes = run(files[1], files[2], per_trigger=1)
    got = arrival.admitted_features(outcomes).select(*FEATURE_COLUMNS)
    want = batch_features(spark, population)
    assert want.count() > 5
    assert audit.serving_skew(got, want).collect() == []


def test_one_file_gives_the_same(spark, population, run):
    random_population(population, 11, patients=6)
    population.rows["conditions"] = list({(r["PATIENT"], r["ENCOUNTER"], r["CODE"], r["START"]): r for r in population.rows["conditions"]}.values())
    outcomes = run(write_envelopes(population.raw(spark)))
    assert audit.serving_skew(arrival.admitted_features(outcomes), batch_features(spark, population)).isEmpty()


def test_refusals_duplicates_and_conflicts(spark, population, run):
    stay = ("e", "p", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")
    population.stay(*stay)
    discharge = write_envelopes({"encounters": population.raw(spark)["encounters"]})
    person = write_envelopes({"patients": type(population)().patient("p").raw(spark)["patients"]})
    changed = write_envelopes({"encounters": type(population)().stay(*stay, "wellness").raw(spark)["encounters"]})
    outcomes = [run(x).groupBy("outcome").count().collect() for x in (discharge, person, discharge, discharge, changed)]
    last = {r["outcome"]: r["count"] for r in outcomes[-1]}
    assert last == {"refused_no_demographics": 1, "stored": 1, "discharge": 1, "duplicate": 1, "conflict": 1}
    assert run(discharge).filter("outcome = 'conflict'").first()["differing"] == "ENCOUNTERCLASS"


def test_patient_row_cap(spark, population, run):
    population.patient("p")
    for n in range(5):
        population.course("p", f"2024-01-0{n + 1}T00:00:00Z")
    outcomes = run(write_envelopes(population.raw(spark)), max_rows=3)
    assert outcomes.filter("outcome = 'refused_row_cap'").count() == 2


def test_a_flood_for_one_patient_is_cut_in_arrival_order(spark, population, run):
    population.patient("p")
    for n in range(40):
        population.course("p", f"2024-01-{n % 28 + 1:02d}T{n % 24:02d}:00:00Z", code=f"m{n}")
    lines = write_envelopes(population.raw(spark)).repartition(3)
    outcomes = run(lines, max_rows=6)
    counts = {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    assert counts == {"stored": 7, "refused_row_cap": 34}
    first = sorted((r["START"], r["CODE"]) for r in population.rows["medications"])[:6]
    kept = outcomes.filter("outcome = 'stored' AND kind = 'medication'").collect()
    assert sorted(r["event_key"].split("|")[2] for r in kept) == sorted(c for _, c in first)


def test_old_history_is_dropped_without_changing_features(spark, population, run):
    population.patient("p").course("p", "2018-01-01T00:00:00Z", "2018-02-01T00:00:00Z").course("p", "2018-01-01T00:00:00Z", "", "long")
    population.diagnosis("p", "2018-01-01", "2018-03-01", "44054006").stay("old", "p", "2018-01-01T00:00:00Z", "2018-01-05T00:00:00Z")
    population.stay("new", "p", "2024-01-01T00:00:00Z", "2024-01-05T00:00:00Z")
    files = list(slices(population.raw(spark), ["2019", "2023"]))
    outcomes = run(*files, per_trigger=1, slack_days=30)
    assert audit.serving_skew(arrival.admitted_features(outcomes), batch_features(spark, population)).isEmpty()


def scheduled(spark, population, tmp_path, seed=13):
    random_population(population, seed)
    f = population.typed(spark)
    schedule = label_schedule(f).join(f["encounters"].select(F.col("id").alias("encounter_id"), F.col("patient").alias("entity")), "encounter_id").select(
        "entity", "encounter_id", "label", F.to_timestamp("due_at").alias("due_at"))
    arrivals = f["encounters"].filter("stop IS NOT NULL").select("id", "stop")
    schedule.write.parquet(str(tmp_path / "schedule"))
    arrivals.repartitionByRange(5, "stop").write.parquet(str(tmp_path / "arrivals"))
    read = lambda n, df, files: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / n))
    arrival.use_state_store(spark)
    return schedule, arrivals, lambda files, **more: release.released_labels(
        read("schedule", schedule, 100), read("arrivals", arrivals, files), "stop", **more)


@pytest.mark.parametrize("files", [1, 5])
def test_labels_are_released_once_and_never_early(spark, population, tmp_path, files):
    schedule, arrivals, stream = scheduled(spark, population, tmp_path)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    monitoring.run_available(stream(files), check, path=out)
    got = spark.read.parquet(out).collect()
    now = arrivals.agg(F.max("stop")).first()[0]
    want = {r["encounter_id"]: r["label"] for r in schedule.collect() if r["due_at"] <= now}
    assert want and len(got) == len(want) and {r["encounter_id"]: r["label"] for r in got} == want
    assert all(now >= r["released_at"] >= r["due_at"] for r in got)
    # The schedule posted again releases nothing; a later arrival releases what was waiting.
    schedule.write.mode("append").parquet(str(tmp_path / "schedule"))
    monitoring.run_available(stream(files), check, path=out)
    assert spark.read.parquet(out).count() == len(want)
    end = schedule.agg(F.max("due_at")).first()[0]
    spark.createDataFrame([("last", end)], arrivals.schema).write.mode("append").parquet(str(tmp_path / "arrivals"))
    monitoring.run_available(stream(files), check, path=out)
    assert {r["encounter_id"] for r in spark.read.parquet(out).collect()} == {r["encounter_id"] for r in schedule.collect()}
    assert spark.read.parquet(out).count() == schedule.count()


def test_labels_in_the_release_log_are_not_released_again(spark, population, tmp_path):
    schedule, arrivals, stream = scheduled(spark, population, tmp_path)
    out = str(tmp_path / "out")
    held = schedule.orderBy("encounter_id").limit(5).select("entity", "encounter_id")
    held.write.parquet(str(tmp_path / "held"))
    held = spark.read.parquet(str(tmp_path / "held"))
    monitoring.run_available(stream(5, released=held), str(tmp_path / "check"), path=out)
    now = arrivals.agg(F.max("stop")).first()[0]
    known = {r["encounter_id"] for r in held.collect()}
    want = {r["encounter_id"] for r in schedule.collect() if r["due_at"] <= now} - known
    assert {r["encounter_id"] for r in spark.read.parquet(out).collect()} == want


def test_the_stream_answers_what_the_log_lacks(spark, population, run, tmp_path):
    random_population(population, 11, patients=6)
    population.rows["conditions"] = list({(r["PATIENT"], r["ENCOUNTER"], r["CODE"], r["START"]): r for r in population.rows["conditions"]}.values())
    lines = write_envelopes(population.raw(spark))
    want = batch_features(spark, population)
    ids = sorted(r["encounter_id"] for r in want.select("encounter_id").collect())
    logged = want.filter(~F.col("encounter_id").isin(ids[::3])).select("patient_id", "encounter_id", F.lit("2024-01-01").cast("timestamp").alias("event_time"))
    logged.write.parquet(str(tmp_path / "log"))
    log = arrival.scored_encounters(spark.read.parquet(str(tmp_path / "log")))
    got = arrival.admitted_features(run(lines, log=log)).select(*FEATURE_COLUMNS)
    assert {r["encounter_id"] for r in got.collect()} == set(ids[::3])
    assert audit.serving_skew(got, want.filter(F.col("encounter_id").isin(ids[::3]))).isEmpty()
    # Scores that are in the state are not asked for again.
    assert arrival.admitted_features(run(lines, log=log)).count() == len(ids[::3])


def test_state_expires_and_late_rows_come_out_whole(spark, population, run):
    population.patient("p")
    for year in range(2010, 2024):
        population.course("p", f"{year}-01-01T00:00:00Z", f"{year}-02-01T00:00:00Z", code=f"m{year}")
        population.stay(f"e{year}", "p", f"{year}-03-01T00:00:00Z", f"{year}-03-04T00:00:00Z")
    whole = write_envelopes(population.raw(spark))
    assert run(whole, slack_days=30).filter("outcome = 'discharge'").count() == 14
    population.rows["encounters"].clear()
    population.rows["medications"].clear()
    population.course("p", "2015-06-01T00:00:00Z", code="late").stay("on-time", "p", "2023-02-20T00:00:00Z", "2023-02-25T00:00:00Z")
    population.stay("e2012", "p", "2012-03-01T00:00:00Z", "2012-03-04T00:00:00Z")
    again = run(write_envelopes({n: population.raw(spark)[n] for n in ("encounters", "medications")}), slack_days=30)
    assert {(r["kind"], r["body"] is not None) for r in again.filter("outcome = 'late'").collect()} == {("medication", True), ("encounter", True)}
    row = arrival.admitted_features(again).filter("encounter_id = 'on-time'").first()
    assert row is not None and row["prior_inpatient_180d"] == 0 and row["active_medication_count"] == 0


def test_state_rows_are_bounded_with_slack(spark, population, tmp_path):
    arrival.use_state_store(spark)
    population.patient("p")
    for n in range(300):
        population.course("p", f"{2000 + n // 12}-{n % 12 + 1:02d}-01T00:00:00Z", f"{2000 + n // 12}-{n % 12 + 1:02d}-09T00:00:00Z", code=f"m{n}")
    counts = {}
    for slack in (None, 30):
        source, out, check = (str(tmp_path / f"{n}-{slack}") for n in ("lines", "out", "check"))
        write_envelopes(population.raw(spark)).coalesce(1).write.text(source)
        monitoring.run_available(arrival.ingest(stream_lines(spark, source), slack_days=slack), check, path=out)
        counts[slack] = {r["name"]: r["n_rows"] for r in monitoring.state_rows(spark, check, ("history", "seen", "scored")).collect()}
        marked = spark.read.parquet(out).filter("outcome = 'stored'").count()
        assert marked == 301
    assert counts[None] == {"history": 300, "seen": 301, "scored": 0}
    # Within thirty days of the newest arrival, and the demographics.
    assert counts[30]["history"] <= 2 and counts[30]["seen"] <= 3


def test_prediction_and_label_logs(spark, population, tmp_path):
    random_population(population, 17, patients=5)
    rows = batch_features(spark, population)
    stops = population.typed(spark)["encounters"].select(F.col("id").alias("encounter_id"), F.col("stop").alias("event_time"))
    batch = logged_features(rows.join(stops, "encounter_id"), MODEL_INPUTS).selectExpr(
        "patient_id", "encounter_id", "event_time", "'h' AS input_hash", "'m' AS model_name", "1 AS model_version",
        "'1.1.0' AS feature_version", "'1.0.0' AS cohort_version", "los_days / 100 AS score", "features",
    )
    log = PredictionLog(spark, str(tmp_path / "predictions"))
    total = batch.count()
    half = batch.filter(F.xxhash64("encounter_id") % 2 == 0)
    log.record(half)
    log.record(batch.withColumn("score", F.lit(0.0)))
    stored = [r for r in log.all().collect()]
    assert [r["prediction_id"] for r in stored] == list(range(1, total + 1))
    kept = {r["encounter_id"] for r in half.collect()}
    assert all((r["score"] != 0.0) == (r["encounter_id"] in kept) for r in stored)
    assert log.has("encounter_id", stored[0]["encounter_id"]) and log.of_encounter("none").isEmpty()
    assert audit.missing_features(log.read(), MODEL_INPUTS).isEmpty()
    assert audit.logged_model(log.read()) == ("m", 1)

    labels = LabelLog(spark, str(tmp_path / "labels"))
    due = log.read().selectExpr("encounter_id", "1 AS label", "'1.0.0' AS label_version", "event_time + INTERVAL 30 DAYS AS due_at",
                                "event_time + INTERVAL 31 DAYS AS released_at")
    assert labels.record(due, log.read()) == total and labels.record(due, log.read()) == 0
    assert audit.early_labels(log.read(), labels.read()).first()["early"] == 0
    with pytest.raises(UnscoredDischarge, match="ghost"):
        labels.record(due.limit(1).withColumn("encounter_id", F.lit("ghost")), log.read())
    with pytest.raises(ValueError, match="before"):
        audit.realized_performance(log.read(), labels.read(), "2024-01-01", "2024-01-01")
    assert audit.realized_performance(log.read(), labels.read(), "2000-01-01", "2030-01-01").first()["auroc"] is None


def test_event_store_is_idempotent(spark, population, tmp_path):
    population.patient("p").stay("e", "p", "2024-01-01T00:00:00Z", "").course("p", "2024-01-01T00:00:00Z").diagnosis("p", "2024-01-01")
    raw = population.raw(spark)
    store = EventStore(spark, str(tmp_path / "state"))
    assert {r["kind"]: r["loaded"] for r in preload(store, raw).collect()} == {"patient": 1, "encounter": 1, "medication": 1, "condition": 1}
    assert {r["already_present"] for r in preload(store, raw).collect()} == {1}
    changed = raw["encounters"].withColumn("STOP", F.lit("2024-01-02T00:00:00Z")).unionByName(
        type(population)().stay("f", "p", "2024-01-01T00:00:00Z", "").raw(spark)["encounters"])
    loaded, conflicts = store.record("encounters", changed)
    assert loaded == 1 and [tuple(r["differing"]) for r in conflicts.collect()] == [("STOP",)]
    assert {r["Id"]: r["STOP"] for r in store.frames()["encounters"].collect()} == {"e": "", "f": ""}


def test_one_reference_per_version(spark, tmp_path):
    store = ReferenceStore(spark, str(tmp_path / "refs"))
    rows = spark.createDataFrame([("score", 0.5)], "signal STRING, value DOUBLE")
    assert store.read("m", 1) is None
    store.record(rows, "m", 1)
    with pytest.raises(ReferenceExists):
        store.record(rows, "m", 1)
    store.record(rows, "m", 2)
    assert store.read("m", 1).first()["value"] == 0.5


def test_segments_and_cursor(spark, population):
    switches = (("2024-01-01T00:00:00Z", "a"), ("2024-02-01T00:00:00Z", "b"))
    rows = [(p, at) for p in "ab" for at in ("2023-12-31T23:59:59Z", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", "open:2024-01-01")]
    df = spark.createDataFrame(rows, "population STRING, at STRING")
    got = {tuple(r) for r in df.filter(F.col("population") == order.owner(switches, F.col("at"))).collect()}
    assert got == {("a", "2024-01-01T00:00:00Z"), ("b", "2024-02-01T00:00:00Z"), ("b", "open:2024-01-01")}

    random_population(population, 19, patients=3)
    events = order.with_sequence(order.event_stream(population.raw(spark))).orderBy("seq").collect()
    keys = [(r["at"], r["kind_order"], r["row_key"]) for r in events]
    assert keys == sorted(keys) and [r["seq"] for r in events] == list(range(1, len(events) + 1))
    cursor = keys[4]
    due = order.due_after(order.event_stream(population.raw(spark)), cursor, keys[20][0])
    assert due.count() == sum(k > cursor and k[0] <= keys[20][0] for k in keys)


def test_a_filter_on_the_instant_does_not_write_it_out_again(spark):
    events = order.event_stream(testdata.raw_population(spark, SMALL))
    owned = events.filter(order.owner((("1997-01-01T00:00:00Z", "a"), ("1998-01-01T00:00:00Z", "b")), F.col("at")) == "a")
    plan = owned.select("kind")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("date_format" in line for line in filters)


def test_rows_refused_for_other_reasons_do_not_count_towards_the_cap(spark, population, run):
    for n in range(30):
        population.stay(f"e{n}", "p", f"2024-01-{n % 28 + 1:02d}T00:00:00Z", f"2024-02-{n % 28 + 1:02d}T00:00:00Z")
    for n in range(3):
        population.course("p", f"2024-03-0{n + 1}T00:00:00Z", code=f"m{n}")
    outcomes = run(write_envelopes(population.raw(spark)), max_rows=10)
    counts = {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    assert counts == {"refused_no_demographics": 30, "stored": 3}
    assert outcomes.filter("outcome LIKE 'refused%' AND body IS NULL").isEmpty()


def late_stay(spark, population):
    population.patient("p").stay("a", "p", "2021-01-01T00:00:00Z", "2021-01-04T00:00:00Z")
    population.stay("z", "p", "2024-05-01T00:00:00Z", "2024-05-04T00:00:00Z")
    first = write_envelopes(population.raw(spark))
    population.rows["encounters"].clear()
    population.stay("b", "p", "2021-02-01T00:00:00Z", "2021-02-03T00:00:00Z")
    return first, write_envelopes({"encounters": population.raw(spark)["encounters"]})


def test_late_discharges_are_answered_from_the_whole_history(spark, population, run):
    first, second = late_stay(spark, population)
    run(first)
    row = arrival.admitted_features(run(second)).filter("encounter_id = 'b'").first()
    assert (row["prior_inpatient_180d"], row["days_since_prev_discharge"]) == (1, 28.0)


def test_discharges_behind_dropped_history_are_told_apart(spark, population, run):
    first, second = late_stay(spark, population)
    run(first, slack_days=365)
    outcomes = run(second, slack_days=365)
    assert [(r["encounter_id"], r["body"] is None) for r in outcomes.filter("outcome = 'late'").collect()] == [("b", False)]


class Recorded:
    """State of one patient in memory that counts the calls a processor makes."""

    def __init__(self):
        self.calls, self.timers = [], set()

    def variable(self, name):
        held = []

        class Variable:
            def get(_):
                self.calls.append(f"{name}.get")
                return iter(held) if name not in ("person",) else (held[0] if held else None)

            def exists(_):
                self.calls.append(f"{name}.exists")
                return bool(held)

            def appendList(_, rows):
                self.calls.append(f"{name}.appendList")
                held.extend(rows)

            def put(_, rows):
                self.calls.append(f"{name}.put")
                held[:] = rows

            def update(_, row):
                self.calls.append(f"{name}.update")
                held[:] = [row]

            def clear(_):
                held.clear()

        return Variable()

    def getListState(self, name, _schema):
        return self.variable(name)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_patient_has_one_timer_however_many_labels_wait():
    state, row = Recorded(), Row("encounter_id", "label", "due_us")
    patient = release.PendingLabels()
    patient.init(state)
    state.now = 0
    assert list(patient.handleInputRows(("p",), iter([row(f"e{n}", n % 2, 5_000 * n) for n in range(9, 0, -1)]), state)) == []
    assert state.timers == {5} and state.calls.count("timer") == 1
    # An earlier label takes the timer over; what fires asks for the next instant only.
    assert list(patient.handleInputRows(("p",), iter([row("first", 1, 2_500)]), state)) == [] and state.timers == {3}
    state.now = 11
    state.timers.clear()
    assert [r.encounter_id for r in patient.handleExpiredTimer(("p",), state, None)] == ["e1", "e2", "first"]
    assert state.timers == {15}


def test_a_new_patient_costs_one_read_of_state():
    state = Recorded()
    patient = arrival.PatientState()
    patient.init(state)
    names = ("entity", "kind", "at", "kind_order", "row_key", "event_key", "input_hash", "start_us", "stop_us", "at_us", "birth_day",
             "death_day", "encounter_id", "encounter_class", "is_disorder", "bits", "prints")
    person = Row(*names)("p", "patient", "", -1, "Id=p", "patient|p", "h", None, None, None, 1, None, "p", None, False, 0, "x")
    assert [r.outcome for r in patient.handleInputRows(("p",), iter([person]), state)] == ["stored"]
    assert [c for c in state.calls if c.endswith((".get", ".exists"))] == ["person.get"]
    assert [r.outcome for r in patient.handleInputRows(("p",), iter([person]), state)] == ["duplicate"]


class Held(Recorded):
    """State whose variables can be read."""

    def __init__(self):
        super().__init__()
        self.held = {}

    def variable(self, name):
        return self.held.setdefault(name, super().variable(name))

    def blocks(self):
        return list(self.held["entries"].get())


def test_a_patient_keeps_all_lists_in_one_and_many_entries_a_row():
    state = Held()
    patient = arrival.PatientState(expiring=True)
    patient.init(state)
    day = 86_400_000_000
    names = (*arrival.EVENT, "kind_order", "at_us", "encounter_id")
    course = lambda n: Row(*names)(
        "p", "medication", f"{n:05d}", "k", f"medication|{n}", "h", n * day, (n + 5) * day, None, None, None, False, 0, "x", 2, n * day, None
    )
    state.now = 0
    assert len(list(patient.handleInputRows(("p",), map(course, range(1, 1201)), state))) == 1200
    assert [c for c in state.calls if c.startswith("entries.")] == ["entries.appendList"]
    assert [len(b[0]) for b in state.blocks()] == [1000, 1000, 400]
    state.now, state.calls[:] = 1100 * day // 1000, []
    assert list(patient.handleExpiredTimer(("p",), state, None)) == []
    assert state.calls == ["entries.get", "entries.put", "person.get", "timer", "person.update"]
    # Keys from the watermark on, and courses that end behind it.
    (block,) = state.blocks()
    assert sorted(block[0]) == [arrival.History.COURSE] * 105 + [arrival.SEEN] * 101
    assert [r.outcome for r in patient.handleInputRows(("p",), map(course, (1099, 1100, 1201)), state)] == ["late", "duplicate", "stored"]


def test_a_refused_row_carries_its_payload(spark, population, run):
    population.stay("e=1", "p", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", "say \"a=b\"")
    body = run(write_envelopes({"encounters": population.raw(spark)["encounters"]})).first()["body"]
    assert json.loads(body) == {"Id": "e=1", "PATIENT": "p", "START": "2024-01-01T00:00:00Z", "STOP": "2024-01-02T00:00:00Z",
                                "ENCOUNTERCLASS": "say \"a=b\""}


def test_an_outcome_carries_the_hash_of_its_line(spark, population, run):
    population.patient("p").stay("e", "p", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")
    lines = write_envelopes(population.raw(spark))
    want = {hashlib.sha256(r["value"].encode()).hexdigest() for r in lines.collect()}
    assert {r["input_hash"] for r in run(lines).collect()} == want
    assert dict(arrival.handler_rows(parse_envelopes(lines)).dtypes)["input_hash"] == "binary"


def test_a_batch_is_told_apart_once(spark, population, tmp_path, monkeypatch):
    from anchorline.sources import logs

    plans, compare = [], logs.conflicts_with

    def seen(incoming, stored, new, *rest):
        plans.append(new._jdf.queryExecution().optimizedPlan().toString())
        return compare(incoming, stored, new, *rest)

    monkeypatch.setattr(logs, "conflicts_with", seen)
    population.patient("p").stay("e", "p", "2024-01-01T00:00:00Z", "")
    store = EventStore(spark, str(tmp_path / "state"))
    assert store.record("encounters", population.raw(spark)["encounters"])[0] == 1
    assert plans and not any("Aggregate" in p or "Join" in p for p in plans)


def packed(entity, kind, *fields, bits=0):
    return Row("bucket", "event")(7, arrival.SEPARATOR.join([entity, kind, "0", str(bits), *fields]))


def test_patients_of_a_bucket_cost_its_calls_once():
    state = Held()
    patients = arrival.BucketState(expiring=True)
    patients.init(state)
    state.now = 0
    born = [packed(f"p{n}", "patient", "1960-01-01", "") for n in range(50)]
    courses = [packed(f"p{n}", "medication", "m", "e", f"2020-01-{d:02d}T00:00:00Z", f"2020-01-{d + 1:02d}T00:00:00Z") for n in range(50) for d in (1, 2)]
    rows = list(patients.handleInputRows((7,), iter(courses + born), state))
    assert sorted((r.entity, len(r.results)) for r in rows) == sorted((f"p{n}", 3) for n in range(50))
    assert state.calls == ["entries.get", "entries.appendList", "timer"] and len(state.timers) == 1
    # A later batch reads what it needs, writes what is new, and the timer stands.
    state.calls[:] = []
    (row,) = patients.handleInputRows((7,), iter([courses[0], packed("p0", "medication", "n", "e", "2020-01-03T00:00:00Z", "")]), state)
    assert sorted(r.split(arrival.SEPARATOR)[0] for r in row.results) == ["duplicate", "stored"]
    assert state.calls == ["entries.get", "entries.appendList"] and len(state.blocks()) == 51
    # What is due is dropped for all of them at once.
    day = 86_400_000
    (first,), state.now, state.calls[:] = state.timers, 18_264 * day, []
    assert first == 18_262 * day + 1
    state.timers.clear()
    assert list(patients.handleExpiredTimer((7,), state, None)) == []
    assert state.calls == ["entries.get", "entries.put", "timer"] and len(state.blocks()) == 50 and len(state.timers) == 1


def test_a_bucket_reads_its_part_of_a_log_in_one_row():
    state = Held()
    patients = arrival.BucketState()
    patients.init(state)
    logged = [{"entity": p, "encounter_id": f"e{n}", "at_us": n} for p in "pq" for n in range(3)]
    patients.handleInitialState((7,), Row(logged=logged), state)
    assert [b[0] for b in state.blocks()] == ["p", "q"]
    stay = lambda n: packed("p", "encounter", "inpatient", f"e{n}", "2020-01-01T00:00:00Z", "2020-01-02T00:00:00Z")
    (row,) = patients.handleInputRows((7,), iter([packed("p", "patient", "1960-01-01", ""), stay(1), stay(5)]), state)
    told = [r.split(arrival.SEPARATOR) for r in row.results]
    assert [(t[0], t[2]) for t in told] == [("stored", "patient|p"), ("stored", "encounter|e1"), ("discharge", "encounter|e5")]


def test_packed_events_read_as_the_rows_they_are_made_of(spark, population):
    random_population(population, 23, patients=3)
    population.patient("q", "1931-02-28", "1999-12-31").stay("open", "q", "0099-03-01T23:59:58Z", "").diagnosis("q", "2020-02-29", "", "44054006")
    rows = arrival.handler_rows(parse_envelopes(write_envelopes(population.raw(spark))))
    want = {r["prints"]: r for r in rows.collect()}
    same = [c for c in arrival.EVENT if c not in ("row_key", "input_hash")]
    got = [arrival.unpacked(r["event"]) for r in arrival.packed_events(rows).collect()]
    assert len(got) == rows.count() and {r.kind for r in got} == {"patient", "encounter", "medication", "condition"}
    assert all(getattr(r, c) == want[r.prints][c] for r in got for c in same)
    # Ties are broken alike.
    by_row = sorted(want.values(), key=lambda r: (r["kind"], r["entity"], r["row_key"]))
    assert by_row == sorted(want.values(), key=lambda r: (r["kind"], r["entity"], r["prints"]))


def test_only_packed_events_are_shuffled(spark, population):
    population.patient("p").course("p", "2024-01-01T00:00:00Z")
    lines = write_envelopes(population.raw(spark))
    events = arrival.packed_events(arrival.handler_rows(parse_envelopes(lines)))
    assert events.columns == ["bucket", "event"]
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    # Hashes of lines and of fields take most room and are not needed to keep state.
    assert "sha2" not in plan and "hex(" not in plan


def test_state_takes_little_room():
    day = 86_400_000_000
    entries = []
    for n in range(1000):
        code, stay, start = str(n * 7919 % 20_000), str(n // 5 * 37), f"2020-{n % 11 + 1:02d}-{n % 28 + 1:02d}T00:00:00Z"
        at = arrival._micros(start)
        entries.append((arrival.SEEN, at, None, "medication", arrival.SEPARATOR.join([code, stay, start, ""])))
        entries.append((arrival.History.COURSE, at, at + n % 30 * day if n % 3 else None, None, None))
    # Keys that are given whole, fields without an instant, and scores are kept as they are.
    odd = [
        (arrival.SEEN, 5, None, "medication|a|b", "x"), (arrival.SEEN, None, None, "patient|p", "1960-01-01" + arrival.SEPARATOR),
        (arrival.SEEN, 7, None, "medication|c", entries[0][4]), (arrival.SEEN, None, None, "encounter", "a\x1fe|1\x1f2020-01-01T00:00:00Z\x1f"),
        (arrival.SCORED, 86_400_000_001, None, "e|2 \u00e9\"", None), (arrival.History.FLAG, -1, 3, None, None),
    ]

    class State:
        def __init__(self, rows):
            self.rows = arrival.blocks(rows)

        def get(self):
            return iter(self.rows)

    for rows in (entries, odd, odd[::-1], entries[:999] + odd + entries[999:]):
        assert list(arrival.entries_of(State(rows))) == rows
    assert sum(len(part) for b in State(entries).rows for part in b) < 25 * 1000
