from datetime import datetime

import numpy as np
import pytest
from tables import SMALL
from pyspark.sql import functions as F
from test_features import random_population

from anchorline.operators import monitor
from anchorline.plans import audit, training
from anchorline.plans.reference import build_reference, export_arrays
from anchorline.plans.scoring import EmptyBatch, batch_report, run_batch, select_held_out_batch
from anchorline.sources.logs import PredictionLog
from anchorline.sources.testdata import population as adapter


def test_windows_are_clipped_and_half_open(spark):
    rows = [("before", "2023-12-31 23:59:59"), ("first", "2024-01-01 00:00:00"), ("edge", "2024-01-08 00:00:00"), ("last", "2024-02-28 00:00:00")]
    df = spark.createDataFrame(rows, "id STRING, t STRING").withColumn("at", F.col("t").cast("timestamp"))
    got = {}
    for r in monitor.in_windows(df, "at", "2024-01-01", "2024-02-29").collect():
        got.setdefault(r["id"], []).append(r["boundary"])
    grid = monitor.grid(spark, "2024-01-01", "2024-02-29").orderBy("boundary").collect()
    want = {}
    for b in grid:
        for name, t in rows:
            if b["window_start"] <= datetime.fromisoformat(t) < b["boundary"]:
                want.setdefault(name, []).append(b["boundary"])
    assert {k: sorted(v) for k, v in got.items()} == want
    assert len(grid) == 8 and grid[0]["window_start"] == datetime(2024, 1, 1) and "before" not in got and "last" not in got
    assert monitor.grid(spark, "2024-01-01", "2024-01-07").count() == 0


def test_ks_is_the_largest_gap(spark):
    rng = np.random.default_rng(1)
    ref, live = rng.integers(0, 30, 400) / 10, rng.integers(5, 40, 90) / 10
    r = spark.createDataFrame([("s", float(v)) for v in ref], "signal STRING, value DOUBLE")
    b = spark.createDataFrame([(1, "s", float(v)) for v in live], "boundary INT, signal STRING, value DOUBLE")
    points = np.unique(np.concatenate([ref, live]))
    want = max(abs((ref <= p).mean() - (live <= p).mean()) for p in points)
    got = monitor.ks_two_sample(r, b).first()
    assert got["ks"] == pytest.approx(want, abs=1e-12) and (got["n_reference"], got["n_live"]) == (400, 90)
    apart = monitor.ks_two_sample(r, b.withColumn("value", F.col("value") + 100)).first()
    assert apart["ks"] == 1.0 and apart["p_value"] < 1e-20


def test_stability_index_of_the_same_sample_is_zero(spark):
    r = spark.createDataFrame([("s", float(i)) for i in range(100)], "signal STRING, value DOUBLE")
    live = r.withColumn("boundary", F.lit(1))
    edges = monitor.decile_edges(r)
    assert monitor.stability_index(r, live, edges).first()["psi"] == pytest.approx(0.0, abs=1e-12)
    assert monitor.stability_index(r, live.withColumn("value", F.col("value") + 95), edges).first()["psi"] > 5


def test_proportions(spark):
    make = lambda ones, n: [("f", 1.0)] * ones + [("f", 0.0)] * (n - ones)
    r = spark.createDataFrame(make(50, 200), "signal STRING, value DOUBLE")
    live = spark.createDataFrame(make(40, 100), "signal STRING, value DOUBLE").withColumn("boundary", F.lit(1))
    got = monitor.proportion_tests(r, live).first()
    pooled = 90 / 300
    z = (0.25 - 0.4) / np.sqrt(pooled * (1 - pooled) * (1 / 200 + 1 / 100))
    assert got["z"] == pytest.approx(z) and 0.007 < got["p_value"] < 0.008
    none = spark.createDataFrame(make(0, 10), "signal STRING, value DOUBLE")
    assert monitor.proportion_tests(none, none.withColumn("boundary", F.lit(1))).first()["z"] is None


def test_alerts_and_rules(spark):
    stats = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.2), (2, "a", 0.3)], "boundary INT, signal STRING, statistic DOUBLE")
    limits = spark.createDataFrame([("a", 0.3), ("b", 0.1)], "signal STRING, threshold DOUBLE")
    assert {(r["sim_at"], r["signal"]) for r in monitor.alerts(stats, limits).collect()} == {(1, "a"), (1, "b")}
    same = monitor.thresholds_hash(limits.orderBy(F.desc("signal"))).first()[0]
    assert same == monitor.thresholds_hash(limits).first()[0] != monitor.thresholds_hash(limits.replace(0.3, 0.4)).first()[0]
    labels = spark.createDataFrame([(1, 1, 5, 5), (2, 2, 5, 6), (3, 0, 5, 4), (4, 0, 5, 5), (4, 0, 5, 5)],
                                   "prediction_id INT, label INT, due_at INT, released_at INT")
    assert {tuple(r) for r in monitor.label_violations(labels).collect()} == {
        (2, "label_is_binary"), (3, "released_after_due"), (4, "one_per_prediction")}


def test_reconciliation_names_every_difference(spark):
    cohort = spark.createDataFrame([("a", "2024-01-01"), ("b", "2025-02-01"), ("c", "2025-03-01")], "encounter_id STRING, s STRING")
    cohort = cohort.withColumn("stop", F.col("s").cast("timestamp"))
    logged = spark.createDataFrame([("a",), ("b",), ("x",)], "encounter_id STRING")
    assert {tuple(r) for r in audit.partition_log(cohort, logged, "2025-01-01").collect()} == {
        ("a", "pre_cutoff"), ("b", "held_out"), ("c", "unscored"), ("x", "unexpected")}
    assert [r[0] for r in audit.unscored(cohort, logged).select("encounter_id").collect()] == ["c"]


def test_changed_rows_break_provenance(spark, population):
    raw = population.stay("e", "p", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z").raw(spark)["encounters"]
    digest = audit.source_hashes(raw).first()["recomputed_hash"]
    log = spark.createDataFrame([(1, "e", digest, 0.5), (2, "gone", digest, 0.5)], "prediction_id INT, encounter_id STRING, input_hash STRING, score DOUBLE")
    rescored = spark.createDataFrame([("e", 0.5000000000000001)], "encounter_id STRING, rescored DOUBLE")
    got = {r["encounter_id"]: r for r in audit.verify_predictions(log, raw, rescored).collect()}
    assert got["e"]["hash_matches"] and not got["e"]["score_matches"] and not got["gone"]["has_source"]
    assert audit.score_gaps(audit.verify_predictions(log, raw, rescored)).first()["ulps"] == 1
    changed = raw.withColumn("STOP", F.lit("2024-01-03T00:00:00Z"))
    assert not audit.verify_predictions(log, changed, rescored).filter("encounter_id = 'e'").first()["hash_matches"]


def test_retrain_gates_the_version_it_trained(spark, tmp_path):
    frames = adapter(spark, SMALL)
    registry = training.Registry(spark, str(tmp_path / "registry"))
    version, result, passed = training.retrain(frames, registry, cutoff="2001-01-01", rounds=3, replicates=5, min_rows=10)
    checks = {r["name"]: r["passed"] for r in result.checks.collect()}
    assert version == 1 and checks["holdout_reproduced"] and passed == all(checks.values())
    run = registry.record(1)
    rows = training.training_rows(frames, "2001-01-01")
    assert run["metrics"]["n_train_rows"] + run["metrics"]["n_holdout_rows"] == rows.count()
    train_side, holdout = training.split(rows, run["holdout_fraction"], run["split_seed"])
    assert train_side.join(holdout, "patient_id", "left_semi").isEmpty()
    with pytest.raises(LookupError):
        registry.record(2)
    scored = training.score(registry.load(1), rows)
    reference = build_reference(scored, cutoff="2001-01-01", fraction=run["holdout_fraction"], seed=run["split_seed"])
    sizes = {r["signal"]: r["count"] for r in reference.groupBy("signal").count().collect()}
    assert len(sizes) == 15 and sizes["los_days"] == rows.count() and sizes["score"] == run["metrics"]["n_holdout_rows"]
    assert len(export_arrays(reference.filter("signal = 'score'")).first()["features"]["score"]) == sizes["score"]


def test_held_out_batch_takes_whole_histories(spark):
    frames = adapter(spark, SMALL)
    batch = select_held_out_batch(frames, cutoff="2000-01-01", count=5, seed=3)
    chosen = {r["id"] for r in batch.frames["patients"].collect()}
    assert len(chosen) == 5
    want = frames["encounters"].filter(F.col("patient").isin(*chosen)).count()
    assert batch.frames["encounters"].count() == want
    log = batch.anchors.select("encounter_id", F.lit(0.5).alias("score")).limit(3)
    report = batch_report(batch, log, "2000-01-01")
    assert report.all_scores.first()["count"] == 3
    assert report.partition.filter("bucket = 'unscored'").count() == batch.anchors.count() - 3
    with pytest.raises(EmptyBatch):
        select_held_out_batch(frames, cutoff="2090-01-01", count=5, seed=3)


def test_batch_run_reproduces_its_log(spark, population, tmp_path):
    random_population(population, 23, patients=10)
    raw = population.raw(spark)
    score = lambda df: df.withColumn("score", F.col("los_days") / 100 + F.col("age_at_discharge") / 1000)
    log = PredictionLog(spark, str(tmp_path / "log"))
    options = dict(cutoff="2023-06-01", count=3, seed=1, model=("m", 1))
    run = run_batch(raw, score, log, **options)
    assert run.ok and run.report.partition.count() == run.provenance.count() > 3
    assert run.example.count() == 1
    # The same batch again logs nothing new and still reproduces; another scorer does not.
    before = log.read().count()
    assert run_batch(raw, score, log, **options).ok and log.read().count() == before
    assert not run_batch(raw, lambda df: score(df).withColumn("score", F.col("score") + 1), log, **options).ok


def test_a_log_that_lacks_a_feature_is_refused(spark, population, tmp_path):
    random_population(population, 23, patients=6)
    raw = population.raw(spark)
    score = lambda df: df.withColumn("score", F.col("los_days") / 100)
    log = PredictionLog(spark, str(tmp_path / "log"))
    run_batch(raw, score, log, cutoff="2023-06-01", count=3, seed=1, model=("m", 1))
    good = log.read()
    assert audit.verify_log(good, raw["encounters"], score, ("los_days",)).filter("NOT (has_source AND hash_matches AND score_matches)").isEmpty()
    first = good.agg(F.min("encounter_id")).first()[0]
    for broken in (F.map_filter("features", lambda k, v: k != "los_days"), F.map_concat(F.map_filter("features", lambda k, v: k != "los_days"), F.create_map(F.lit("los_days"), F.lit(float("nan"))))):
        worse = good.withColumn("features", F.when(F.col("encounter_id") == first, broken).otherwise(F.col("features")))
        with pytest.raises(audit.MissingFeature, match=first):
            audit.verify_log(worse, raw["encounters"], score, ("los_days",))


def test_panes_give_the_windows_and_touched_ones_alone_change(spark):
    rng = np.random.default_rng(5)
    start, end = "2024-01-01", "2024-06-30"
    rows = [(i, int(s), float(rng.integers(0, 6)) / 6, int(rng.integers(0, 2)), int(s) + int(r)) for i, (s, r) in enumerate(
        zip(rng.integers(-20, 190, 300) * 43_200, rng.integers(0, 40, 300) * 86_400, strict=True))]
    base = "timestamp'2024-01-01'"
    df = spark.createDataFrame(rows, "prediction_id INT, s INT, score DOUBLE, label INT, r INT").selectExpr(
        "prediction_id", "score", "label", f"{base} + make_dt_interval(0, 0, 0, s) AS event_time", f"{base} + make_dt_interval(0, 0, 0, r) AS released_at")
    got = {(r["boundary"], r["score"]): r["n"] for r in monitor.counted_in_windows(df, "event_time", start, end, ["score"], known="released_at").collect()}
    want = {(r["boundary"], r["score"]): r["n"] for r in monitor.in_windows(df, "event_time", start, end).filter(
        "released_at <= boundary").groupBy("boundary", "score").agg(F.count("*").alias("n")).collect()}
    assert got == want and got
    run = lambda labels, **more: {r["boundary"]: tuple(r) for r in monitor.realized_by_boundary(df.select("prediction_id", "score", "event_time"), labels, start, end, **more).collect()}
    new = df.filter("prediction_id % 29 = 3")
    before, after = run(df.filter("prediction_id % 29 <> 3")), run(df)
    ks = monitor.touched(new, start, end)
    part = run(df, only=ks)
    changed = {b for b in after if after[b] != before[b]}
    assert changed and changed <= set(part) and len(part) == ks[1] - ks[0] + 1
    assert all(part[b] == after[b] for b in part)
    assert monitor.touched(new.filter("false"), start, end) is None


def test_planted_logs_are_made_without_looking_rows_up(spark):
    from anchorline.catalog import audits

    joins = lambda df: sum("Join " in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    # Minors need the birth date of their patient; nothing else is looked up.
    assert joins(audits.releases(spark, SMALL)) == 0 and joins(audits.predictions(spark, SMALL)) == 1


def test_a_log_works_out_what_it_numbers_once(spark, tmp_path, monkeypatch):
    from anchorline.catalog import audits
    from anchorline.sources import logs

    plans, number = [], logs.with_row_number

    def seen(df, *rest):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return number(df, *rest)

    monkeypatch.setattr(logs, "with_row_number", seen)
    log = logs.PredictionLog(spark, str(tmp_path / "log"))
    rows = audits._loggable(spark, SMALL)
    first, again = log.record(rows.filter("bigint(encounter_id) % 2 = 0")), log.record(rows)
    assert len(plans) == 2 and not any("Aggregate" in p or "Join" in p for p in plans)
    assert first.count() > 0 and again.count() > 0 and first.count() + again.count() == rows.count() == log.read().count()
    assert first.agg(F.max("prediction_id")).first()[0] + 1 == again.agg(F.min("prediction_id")).first()[0]


def test_samples_are_counted_once_for_all_statistics(spark):
    from anchorline.catalog import audits

    plan = audits._statistics(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(array(" not in plan
