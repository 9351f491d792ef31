import pytest
from tables import by_id

from anchorline.contracts import ENCOUNTERS
from anchorline.operators.joins import checked_lookup
from anchorline.plans.cohort import build_cohort, classify_encounters, exclusion_counts, split_at_cutoff
from anchorline.sources.raw import typed


def test_first_failed_rule(spark, population):
    p = population.patient("well", "1960-03-10").patient("dead", "1940-01-01", "2024-03-12").patient("young", "2006-02-02")
    p.stay("ed", "dead", "2024-05-01T00:00:00Z", "2024-05-02T00:00:00Z", "emergency")
    p.stay("after-death", "dead", "2024-03-13T00:00:00Z", "2024-03-14T00:00:00Z")
    p.stay("died-on-admission-day", "dead", "2024-03-12T23:00:00Z", "2024-03-14T00:00:00Z")
    p.stay("died-on-discharge-day", "dead", "2024-03-01T00:00:00Z", "2024-03-12T00:00:00Z")
    p.stay("left-alive", "dead", "2024-03-01T00:00:00Z", "2024-03-11T23:59:59Z")
    p.stay("day-before-18", "young", "2024-01-30T00:00:00Z", "2024-02-01T23:00:00Z")
    p.stay("on-18", "young", "2024-01-30T00:00:00Z", "2024-02-02T00:00:00Z")
    p.stay("open", "well", "2024-01-30T00:00:00Z", "")
    f = p.typed(spark)
    reasons = {k: r["exclusion_reason"] for k, r in by_id(classify_encounters(f["encounters"], f["patients"]), "id").items()}
    assert reasons == {
        "ed": "non_inpatient", "after-death": "death_before_admission", "died-on-admission-day": "in_hospital_death",
        "died-on-discharge-day": "in_hospital_death", "left-alive": None, "day-before-18": "under_18", "on-18": None,
        "open": "open_stay",
    }
    counts = {r["exclusion_reason"]: r["encounters"] for r in exclusion_counts(f["encounters"], f["patients"]).collect()}
    # A rule that no stay fails first is counted too.
    assert counts == {
        "non_inpatient": 1, "death_before_admission": 1, "in_hospital_death": 2, "under_18": 1, "open_stay": 1, "unknown_patient": 0,
    }


def test_leap_day_birthday(spark, population):
    population.patient("leap", "2004-02-29")
    population.stay("feb28", "leap", "2022-02-20T00:00:00Z", "2022-02-28T12:00:00Z")
    population.stay("mar1", "leap", "2022-02-20T00:00:00Z", "2022-03-01T12:00:00Z")
    f = population.typed(spark)
    assert {r["encounter_id"]: r["age_at_discharge"] for r in build_cohort(f["encounters"], f["patients"]).collect()} == {"mar1": 18}


def test_unknown_patient_raises_when_strict(spark, population):
    population.patient("p").stay("orphan", "nobody", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")
    f = population.typed(spark)
    assert build_cohort(f["encounters"], f["patients"]).count() == 0
    with pytest.raises(Exception, match="orphan"):
        build_cohort(f["encounters"], f["patients"], strict=True).collect()


def test_repeated_lookup_key_raises(spark):
    left = spark.createDataFrame([(1,)], "k INT")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k INT, v STRING")
    with pytest.raises(Exception, match="not unique"):
        checked_lookup(left, right, ["k"]).collect()


def test_cutoff_halves_are_complements(spark, population):
    population.patient("p")
    for n, stop in enumerate(("2024-12-31T23:59:59Z", "2025-01-01T00:00:00Z", "2025-01-01T00:00:01Z")):
        population.stay(f"e{n}", "p", "2024-12-01T00:00:00Z", stop)
    f = population.typed(spark)
    before, after = split_at_cutoff(build_cohort(f["encounters"], f["patients"]), "2025-01-01")
    assert {r["encounter_id"] for r in before.collect()} == {"e0"}
    assert {r["encounter_id"] for r in after.collect()} == {"e1", "e2"}


@pytest.mark.parametrize("bad", ["2024-1-05T00:00:00Z", "2024-02-30T00:00:00Z", "2024-01-05T00:00:00", "2024-01-05T00:00:00Zx", "2024-01-05"])
def test_strict_typed_view_refuses_other_formats(spark, population, bad):
    population.patient("p").stay("e", "p", bad, "2024-01-06T00:00:00Z")
    raw = population.raw(spark)["encounters"]
    assert typed(raw, ENCOUNTERS).first()["start"] is None
    with pytest.raises(Exception, match="does not match"):
        typed(raw, ENCOUNTERS, strict=True).collect()
