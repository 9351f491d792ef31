import random

import numpy as np
import pytest

import brute
from anchorline.operators import bootstrap
from anchorline.operators.bootstrap import bootstrap_intervals, entity_weights, poisson_level
from anchorline.operators.metrics import calibration, calibration_error, ranking, score_summary
from anchorline.operators.rank import bin_of, exact_quantiles, running_totals, with_row_number
from anchorline.operators.sampling import is_holdout, sample_entities
from anchorline.plans.gate import evaluate, gate_checks, render_report, subgroup_metrics, verdict
from pyspark.sql import functions as F


def scored(spark, n=300, seed=0, levels=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(levels) / levels
        rows.append((i, f"p{i % (n // 3)}", s, int(rng.random() < 0.2 + 0.5 * s)))
    return rows, spark.createDataFrame(rows, "encounter_id INT, patient_id STRING, score DOUBLE, label INT")


def test_ranking_metrics_with_ties(spark):
    rows, df = scored(spark)
    got = ranking(df).first()
    s, y = [r[2] for r in rows], [r[3] for r in rows]
    assert got["auroc"] == pytest.approx(brute.auroc(s, y), abs=1e-12)
    assert got["pr_auc"] == pytest.approx(brute.average_precision(s, y), abs=1e-12)
    assert got["prevalence"] == pytest.approx(np.mean(y))


def test_one_class_has_no_auroc(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score DOUBLE, label INT")
    assert ranking(df).first()["auroc"] is None


def test_a_score_shared_by_most_rows(spark):
    rows = [(0.5, i % 7 == 0) for i in range(2000)] + [(0.9, True), (0.1, False)]
    df = spark.createDataFrame([(s, int(y)) for s, y in rows], "score DOUBLE, label INT")
    assert ranking(df).first()["auroc"] == pytest.approx(brute.auroc([r[0] for r in rows[::20]], [int(r[1]) for r in rows[::20]]), abs=0.05)


@pytest.mark.parametrize("n", [7, 10, 103])
def test_bins_are_array_split(spark, n):
    rows, df = scored(spark, max(n, 9), seed=n)
    df = df.filter(F.col("encounter_id") < n)
    rows = sorted((r for r in rows if r[0] < n), key=lambda r: (r[2], r[0]))
    want = {r[0]: b + 1 for b, chunk in enumerate(np.array_split(np.arange(n), min(10, n))) for r in [rows[i] for i in chunk]}
    ranked = with_row_number(df, ["score", "encounter_id"], "r", total="n")
    got = {r["encounter_id"]: r["b"] for r in ranked.select("encounter_id", bin_of(F.col("r"), F.col("n"), 10).alias("b")).collect()}
    assert got == want
    table = calibration(df, "encounter_id").orderBy("bin").collect()
    for b, chunk in enumerate(np.array_split(np.arange(n), min(10, n))):
        mine = [rows[i] for i in chunk]
        assert table[b]["count"] == len(mine)
        assert table[b]["observed_rate"] == pytest.approx(np.mean([r[3] for r in mine]))
        assert table[b]["lower"] == mine[0][2] and table[b]["upper"] == mine[-1][2]


def test_weighted_calibration_equals_copies(spark):
    rows, df = scored(spark, 60, 4)
    weighted = df.withColumn("w", (F.col("encounter_id") % 4).cast("int"))
    copies = weighted.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("w")))).filter("w > 0")
    copies = copies.withColumn("encounter_id", F.col("encounter_id") * 10 + F.col("c"))
    a = calibration(weighted, "encounter_id", weight="w").orderBy("bin").collect()
    b = calibration(copies, "encounter_id").orderBy("bin").collect()
    assert [(r["bin"], r["count"], pytest.approx(r["mean_score"]), pytest.approx(r["observed_rate"])) for r in a] == [
        (r["bin"], r["count"], r["mean_score"], r["observed_rate"]) for r in b
    ]


def test_quantiles_interpolate(spark):
    values = [random.Random(3).randrange(50) / 7 for _ in range(97)]
    df = spark.createDataFrame([(v,) for v in values], "score DOUBLE")
    got = score_summary(df).first()
    for name, p in (("p05", 5), ("p25", 25), ("p50", 50), ("p75", 75), ("p95", 95)):
        assert got[name] == pytest.approx(np.percentile(values, p), abs=1e-12)
    empty = score_summary(df.limit(0)).first()
    assert empty["count"] == 0 and empty["p50"] is None


def test_running_totals_per_group(spark):
    rows = [(g, i, i % 5) for g in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "g STRING, i INT, v INT")
    out = running_totals(df, ["i"], {"v": F.col("v")}, ["g"]).collect()
    assert len(out) == 400
    for r in out:
        assert r["v_upto"] == sum(i % 5 for i in range(r["i"] + 1)) and r["v_all"] == 400


def test_exact_quantiles_of_groups(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(11)] + [("b", 5.0)], "g STRING, value DOUBLE")
    got = {r["g"]: r["m"] for r in exact_quantiles(df, "value", {"m": 0.5}, ["g"]).collect()}
    assert got == {"a": 5.0, "b": 5.0}


@pytest.mark.parametrize("n", [1, 3, 37, 700])
def test_bootstrap_draws_as_many_entities_as_there_are(spark, n):
    ids = spark.createDataFrame([(f"p{i}",) for i in range(n)], "patient_id STRING")
    weights = {r["patient_id"]: r["weights"] for r in entity_weights(ids, 20, 1).collect()}
    assert len(weights) == n and [sum(c) for c in zip(*weights.values(), strict=True)] == [n] * 20
    again = entity_weights(ids.union(ids).repartition(5), 20, 1)
    assert {r["patient_id"]: r["weights"] for r in again.collect()} == weights
    if n > 3:
        assert weights != {r["patient_id"]: r["weights"] for r in entity_weights(ids, 20, 2).collect()}


def test_weights_follow_the_multinomial_law(spark):
    n, reps = 900, 200
    found = np.array([r["weights"] for r in entity_weights(spark.range(n).select(F.col("id").alias("p")), reps, 3).collect()])
    # Poisson and one-by-one draws together: mean 1, variance 1 - 1/n, and the share never drawn (1 - 1/n)^n.
    assert found.mean() == 1 and abs(found.var() - (1 - 1 / n)) < 0.02
    assert abs((found == 0).mean() - (1 - 1 / n) ** n) < 0.005
    assert poisson_level(n) > 0 and abs(np.corrcoef(found[:, 0], found[:, 1])[0, 1]) < 0.15


def test_replicates_that_hash_to_too_many_draws_are_drawn_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "poisson_level", lambda n: 12)
    found = np.array([r["weights"] for r in entity_weights(spark.range(50).select(F.col("id").alias("p")), 60, 3).collect()])
    assert (found.sum(axis=0) == 50).all()


def plain_metrics(rows):
    """Metrics of rows (score, id, label) written out, ties and copies included."""
    rows = sorted(rows)
    pos, neg = [s for s, _, y in rows if y], [s for s, _, y in rows if not y]
    if not pos or not neg:
        return None
    auroc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = sum(sum(p >= s for p in pos) / (sum(p >= s for p in pos) + sum(n >= s for n in neg)) for s in pos) / len(pos)
    parts = [x for x in np.array_split(np.array([(s, y) for s, _, y in rows]), min(10, len(rows)))]
    ece = sum(len(x) * abs(x[:, 0].mean() - x[:, 1].mean()) for x in parts) / len(rows)
    return auroc, ap, ece, sum((s - y) ** 2 for s, _, y in rows) / len(rows)


@pytest.mark.parametrize("ties", [3, 1000])
def test_every_replicate_equals_the_metrics_of_its_copied_rows(spark, monkeypatch, ties):
    monkeypatch.setattr(bootstrap, "CHUNK", 7)
    draw = random.Random(ties)
    rows = [(i, f"p{draw.randrange(25)}", draw.randrange(ties) / ties, int(draw.random() < 0.3)) for i in range(120)]
    df = spark.createDataFrame(rows, "encounter_id INT, patient_id STRING, score DOUBLE, label INT").repartition(3)
    got = bootstrap.replicate_metrics(df, entity="patient_id", row_id="encounter_id", replicates=30, seed=4)
    weights = {r["patient_id"]: r["weights"] for r in entity_weights(df.select("patient_id"), 30, 4).collect()}
    for rep in range(31):
        copies = [(s, i, y) for i, p, s, y in rows for _ in range(weights[p][rep] if rep < 30 else 1)]
        want = plain_metrics(copies)
        for value, name in zip(want, ("auroc", "pr_auc", "ece", "brier"), strict=True):
            assert got[name][rep] == pytest.approx(value, abs=1e-12), (rep, name)


def test_intervals_need_both_labels_in_some_replicate(spark):
    schema = "encounter_id INT, patient_id STRING, score DOUBLE, label INT"
    ask = lambda rows: bootstrap_intervals(spark.createDataFrame(rows, schema), entity="patient_id", row_id="encounter_id", replicates=4)
    with pytest.raises(ValueError, match="both labels"):
        ask([(1, "a", 0.9, 1), (2, "a", 0.8, 1)])
    with pytest.raises(ValueError, match="both labels"):
        ask([])
    # Four draws of two entities hold both labels with seven in eight; one replicate of one draw each never does.
    with pytest.raises(ValueError, match="no replicate"):
        bootstrap_intervals(spark.createDataFrame([(1, "a", 0.9, 1), (2, "b", 0.1, 0)], schema), entity="patient_id", row_id="encounter_id",
                            replicates=1, seed=next(s for s in range(50) if lonely(spark, s)))


def lonely(spark, seed):
    """Whether the only replicate of a seed draws one of two entities twice."""
    ids = spark.createDataFrame([("a",), ("b",)], "p STRING")
    return max(r["weights"][0] for r in entity_weights(ids, 1, seed).collect()) == 2


def test_intervals_surround_the_estimate(spark):
    _, df = scored(spark)
    got = {r["metric"]: r for r in bootstrap_intervals(df, entity="patient_id", row_id="encounter_id", replicates=40).collect()}
    assert set(got) == {"auroc", "pr_auc", "ece", "brier"}
    for m in ("auroc", "pr_auc", "brier"):
        assert got[m]["ci_low"] <= got[m]["value"] <= got[m]["ci_high"]
        assert got[m]["replicates_used"] == 40


def test_single_class_replicates_are_skipped(spark):
    df = spark.createDataFrame([(1, "a", 0.9, 1), (2, "b", 0.1, 0)], "encounter_id INT, patient_id STRING, score DOUBLE, label INT")
    got = bootstrap_intervals(df, entity="patient_id", row_id="encounter_id", replicates=40, metrics=("auroc", "pr_auc"))
    used = got.first()["replicates_used"]
    assert 0 < used < 40


def test_gate_checks_and_verdict(spark):
    check = lambda auroc, ece, expected=None: {
        r["name"]: r["passed"] for r in gate_checks(spark.createDataFrame([(auroc, ece)], "auroc DOUBLE, ece DOUBLE"), expected).collect()
    }
    assert all(check(0.65, 0.05).values()) and all(check(0.92, 0.0).values())
    assert not check(0.6499, 0.0)["auroc_above_band_floor"]
    assert not check(0.9201, 0.0)["auroc_below_band_ceiling"]
    assert not check(0.8, 0.0501)["ece_within_threshold"]
    assert check(0.8, 0.0, 0.8 + 9e-7)["holdout_reproduced"] and not check(0.8, 0.0, 0.80001)["holdout_reproduced"]
    failed = gate_checks(spark.createDataFrame([(0.99, 0.0)], "auroc DOUBLE, ece DOUBLE"))
    assert verdict(failed).first()["verdict"] == "fail"
    assert "leakage" in failed.filter("not passed").first()["detail"]


def gate_rows(spark):
    _, df = scored(spark, 240, 2)
    flags = ["flag_chf", "flag_chronic_pulmonary", "flag_dementia", "flag_diabetes", "flag_malignancy", "flag_mi", "flag_renal_disease"]
    rows = df.withColumn("age_at_discharge", F.col("encounter_id") % 70 + 18)
    return rows.withColumns({f: (F.col("encounter_id") % (i + 2) == 0).cast("int") for i, f in enumerate(flags)})


def test_small_subgroups_are_suppressed(spark):
    rows = gate_rows(spark)
    people = rows.select(F.col("patient_id").alias("id")).distinct().withColumn("gender", F.lit("M"))
    got = {r["name"]: r for r in subgroup_metrics(rows, people).collect()}
    assert len(got) == 13
    assert got["sex_male"]["n_rows"] == 240 and got["sex_male"]["auroc"] is not None
    assert got["sex_female"]["n_rows"] == 0 and "under_50_rows" in got["sex_female"]["note"]
    assert got["flag_renal_disease"]["n_rows"] == 30 and got["flag_renal_disease"]["auroc"] is None


def test_report_names_the_verdict(spark):
    rows = gate_rows(spark)
    people = rows.select(F.col("patient_id").alias("id")).distinct().withColumn("gender", F.lit("F"))
    result = evaluate(rows, people, replicates=5)
    report = render_report(result, {"model": "m", "version": 1})
    assert report.startswith("# Gate report: ") and "sex_female" in report and "auroc_above_band_floor" in report


def test_split_and_sample_depend_on_ids_only(spark):
    ids = spark.createDataFrame([(f"p{i}",) for i in range(1000)], "patient_id STRING")
    held = ids.filter(is_holdout(F.col("patient_id"), 0.2, 1)).count()
    assert 150 < held < 250
    a = sorted(r[0] for r in sample_entities(ids, 50, 9).collect())
    b = sorted(r[0] for r in sample_entities(ids.repartition(7), 50, 9).collect())
    assert a == b and len(a) == 50
    assert sample_entities(ids, 5000, 9).count() == 1000
    assert a != sorted(r[0] for r in sample_entities(ids, 50, 10).collect())


def test_ece_of_a_perfect_score(spark):
    df = spark.createDataFrame([(i, float(i % 2), i % 2) for i in range(40)], "encounter_id INT, score DOUBLE, label INT")
    assert calibration_error(calibration(df, "encounter_id")).first()["ece"] == 0.0


def test_row_numbers_are_written_once_and_read_without_another_exchange(spark):
    df = spark.range(1000).selectExpr("id", "int(id * 7919 % 13) AS score")
    ranked = with_row_number(df, ["score", "id"], "r", total="n")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan or "FileScan" in plan
    assert "Exchange" not in plan and "Window" not in plan
    rows = ranked.orderBy("r").collect()
    assert [r["r"] for r in rows] == list(range(1, 1001)) and {r["n"] for r in rows} == {1000}
    assert [(r["score"], r["id"]) for r in rows] == sorted((r["score"], r["id"]) for r in rows)
