from pyspark.sql import functions as F
import random
from datetime import datetime, timedelta

import pytest
from tables import by_id

import brute
from anchorline.operators import timeline
from anchorline.contracts import FEATURE_COLUMNS, FLAG_CODES
from anchorline.plans.cohort import build_cohort
from anchorline.plans.features import build_features
from anchorline.plans.labels import build_labels, build_training_rows, label_schedule
from anchorline.plans.serving import serving_features, unservable


def computed(spark, population):
    f = population.typed(spark)
    cohort = build_cohort(f["encounters"], f["patients"])
    return by_id(build_features(cohort, f["encounters"], f["medications"], f["conditions"]))


def test_trailing_window_edges(spark, population):
    # The index discharge is 2024-07-01 12:00; 180 days earlier is 2024-01-03 12:00.
    p = population.patient("p").stay("index", "p", "2024-06-28T12:00:00Z", "2024-07-01T12:00:00Z")
    p.stay("on-edge", "p", "2024-01-02T12:00:00Z", "2024-01-03T12:00:00Z")
    p.stay("past-edge", "p", "2024-01-02T12:00:00Z", "2024-01-03T11:59:59Z", "emergency")
    p.stay("ed", "p", "2024-05-01T00:00:00Z", "2024-05-01T06:00:00Z", "emergency")
    p.stay("urgent", "p", "2024-05-02T00:00:00Z", "2024-05-02T06:00:00Z", "urgentcare")
    p.stay("twin", "p", "2024-06-30T12:00:00Z", "2024-07-01T12:00:00Z")
    p.stay("open", "p", "2024-06-30T12:00:00Z", "")
    got = computed(spark, population)
    assert got["index"]["prior_inpatient_180d"] == 1
    assert got["index"]["prior_ed_180d"] == 1
    assert got["twin"]["prior_inpatient_180d"] == 1
    assert "open" not in got


@pytest.mark.parametrize("prior_stop, gap", [
    ("2023-03-02T08:00:01Z", 365 - 1 / 86400), ("2023-03-02T08:00:00Z", 365.0), ("2023-03-02T07:59:59Z", 365.0),
    ("2024-03-02T08:00:00Z", 0.0),
])
def test_gap_is_clipped(spark, population, prior_stop, gap):
    p = population.patient("p").stay("prior", "p", "2023-02-01T00:00:00Z", prior_stop)
    p.stay("index", "p", "2024-03-01T08:00:00Z", "2024-03-03T08:00:00Z")
    assert computed(spark, population)["index"]["days_since_prev_discharge"] == gap


def test_intervals_at_the_discharge_instant(spark, population):
    p = population.patient("p").stay("index", "p", "2024-08-01T06:00:00Z", "2024-08-05T06:00:00Z")
    p.course("p", "2024-07-01T00:00:00Z", "2024-08-05T06:00:00Z", "stops-at")
    p.course("p", "2024-07-01T00:00:00Z", "2024-08-05T06:00:01Z", "stops-after")
    p.course("p", "2024-08-05T06:00:00Z", "", "starts-at")
    p.course("p", "2024-08-05T06:00:01Z", "", "starts-after")
    p.course("p", "2024-08-04T00:00:00Z", "2024-08-01T00:00:00Z", "reversed")
    p.course("p", "2024-08-06T00:00:00Z", "2024-08-01T00:00:00Z", "reversed-across")
    p.diagnosis("p", "2024-08-05", code="starts-on-day")
    p.diagnosis("p", "2024-01-01", "2024-08-05", code="stops-on-day")
    p.diagnosis("p", "2024-01-01", "2024-08-06", code="stops-next-day")
    p.diagnosis("p", "2024-01-01", code="finding", text="Employed (finding)")
    p.diagnosis("p", "2024-08-06", code="next-day")
    row = computed(spark, population)["index"]
    assert row["active_medication_count"] == 2
    assert row["active_disorder_count"] == 2


def test_flags_read_resolved_history_and_icd10(spark, population):
    p = population.patient("p").stay("index", "p", "2024-08-01T06:00:00Z", "2024-08-05T06:00:00Z")
    p.diagnosis("p", "2010-01-01", "2010-02-01", "399211009", "Past event (situation)")
    p.diagnosis("p", "2015-01-01", "", "C50.9", "Neoplasm (disorder)", "ICD10")
    p.diagnosis("p", "2015-01-01", "", "C50.9", "Not that system (finding)")
    p.diagnosis("p", "2024-08-06", "", "44054006", "After the discharge (disorder)")
    row = computed(spark, population)["index"]
    assert {f for f in FLAG_CODES if row[f]} == {"flag_mi", "flag_malignancy"}


def test_label_edges(spark, population):
    # Discharged 2024-01-01 10:00; the window ends 2024-01-31 10:00.
    for n, start in enumerate(("2024-01-01T10:00:00Z", "2024-01-01T10:00:01Z", "2024-01-31T10:00:00Z", "2024-01-31T10:00:01Z")):
        population.patient(f"p{n}").stay(f"index{n}", f"p{n}", "2023-12-30T10:00:00Z", "2024-01-01T10:00:00Z")
        population.stay(f"next{n}", f"p{n}", start, "2024-02-20T00:00:00Z")
    # An open stay and one the cohort excludes still count as readmissions.
    population.patient("o").stay("before-open", "o", "2023-12-30T10:00:00Z", "2024-01-01T10:00:00Z").stay("open", "o", "2024-01-05T00:00:00Z", "")
    f = population.typed(spark)
    got = by_id(build_labels(build_cohort(f["encounters"], f["patients"]), f["encounters"]))
    assert [got[f"index{n}"]["label"] for n in range(4)] == [0, 1, 1, 0]
    assert got["before-open"]["label"] == 1


def random_population(population, seed, patients=12, hot=None):
    rng = random.Random(seed)
    moment = lambda: datetime(2022, 1, 1) + timedelta(hours=rng.randrange(0, 24 * 900, 6))
    text = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
    codes = [c for codes in FLAG_CODES.values() for c in codes[:2]] + ["1", "2"]
    for n in range(patients):
        pid = f"p{n}"
        population.patient(pid, f"{rng.randrange(1930, 2008)}-0{rng.randrange(1, 10)}-11", rng.choice(["", "", "2023-06-01"]))
        size = hot if hot and n == 0 else rng.randrange(3, 14)
        for k in range(size):
            start = moment()
            stop = "" if rng.random() < 0.05 else text(start + timedelta(hours=rng.randrange(0, 240, 6)))
            population.stay(f"e{n}-{k}", pid, text(start), stop, rng.choice(["inpatient", "inpatient", "emergency", "wellness"]))
            start = moment()
            stop = "" if rng.random() < 0.3 else text(start + timedelta(hours=rng.randrange(-24, 2000, 6)))
            population.course(pid, text(start), stop, f"m{k}")
            start = moment().date()
            stop = "" if rng.random() < 0.4 else str(start + timedelta(days=rng.randrange(0, 200)))
            population.diagnosis(pid, str(start), stop, rng.choice(codes), f"X {rng.choice(['(disorder)', '(finding)'])}",
                                 rng.choice(["SNOMED-CT", "ICD10"]), f"e{k}")
    return population


@pytest.mark.parametrize("seed, hot", [(1, None), (2, None), (3, 120)])
def test_matches_the_plain_rules(spark, population, seed, hot):
    random_population(population, seed, hot=hot)
    f = population.typed(spark)
    got = by_id(build_training_rows(f))
    want, want_labels = brute.features(population.rows), brute.labels(population.rows)
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert {c: got[key][c] for c in row} == row
        assert got[key]["label"] == want_labels[key]
    assert by_id(label_schedule(f)).keys() == want.keys()


def test_no_lookahead(spark, population):
    random_population(population, 5)
    before = computed(spark, population)
    cut = "2023-06-01T00:00:00Z"
    for name in ("encounters", "medications", "conditions"):
        population.rows[name] = [r for r in population.rows[name] if (r["STOP"] if name == "encounters" else r["START"]) < cut]
    for rows in (population.rows["encounters"], ):
        assert all(r["STOP"] < cut for r in rows)
    after = computed(spark, population)
    kept = [k for k in before if k in after]
    assert kept and all(before[k] == after[k] for k in kept)


def test_serving_equals_batch(spark, population):
    random_population(population, 7)
    f = population.typed(spark)
    batch = computed(spark, population)
    ids = spark.createDataFrame([(r["Id"],) for r in population.rows["encounters"][::3]] + [("nowhere",)], "id STRING")
    got = by_id(serving_features(f, ids))
    assert got.keys() == {r["Id"] for r in population.rows["encounters"][::3]} & batch.keys()
    assert all(got[k] == batch[k] for k in got)
    assert [tuple(r) for r in unservable(f, ids).collect()] == [("nowhere", "unknown_encounter")]


def test_column_contract(spark, population):
    population.patient("p").stay("e", "p", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")
    f = population.typed(spark)
    df = build_features(build_cohort(f["encounters"], f["patients"]), f["encounters"], f["medications"], f["conditions"])
    assert tuple(df.columns) == FEATURE_COLUMNS


def test_events_cross_one_exchange(spark, monkeypatch):
    """Summing by instant and the windows inside a slice read the same partitions."""
    seen = []
    whole = timeline.materialize
    monkeypatch.setattr(timeline, "materialize", lambda df: seen.append(df) or whole(df))
    events = spark.range(0, 400).selectExpr("id % 3 AS e", "id * 86400000000L * 9 AS at", "1 AS n")
    anchors = events.filter("n = 1").selectExpr("e", "at")
    got = timeline.trailing_count(anchors, events, entity="e", at="at", span=60 * timeline.DAY, counts={"k": F.lit(True)})
    want = anchors.alias("a").join(events.alias("b"), F.expr("a.e = b.e AND b.at >= a.at - 5184000000000L AND b.at < a.at"), "left").groupBy("a.e", "a.at").agg(F.count("b.n").alias("k"))
    assert sorted(map(tuple, got.select("e", "at", "k").collect())) == sorted(map(tuple, want.collect()))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
