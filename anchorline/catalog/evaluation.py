"""Ranking, calibration, bootstrap and gate queries over the stand-in score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from anchorline.catalog import common
from anchorline.catalog.registry import UNIFORM, holdout_sql, query
from anchorline.contracts import BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED, SPLIT_SEED
from anchorline.operators.bootstrap import WORDS, bootstrap_intervals, entity_weights, poisson_bounds
from anchorline.operators.metrics import brier, calibration, calibration_error, ranking
from anchorline.operators.rank import bin_of, with_row_number
from anchorline.operators.sampling import is_holdout
from anchorline.plans.audit import median_row
from anchorline.plans.gate import evaluate, gate_checks, subgroup_metrics, subgroup_rows, verdict
from anchorline.session import materialize
from anchorline.sources import testdata

REPLICATES = BOOTSTRAP_REPLICATES
PAIRS = """(SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*)
  FROM (SELECT score FROM {0} WHERE label = 1) p, (SELECT score FROM {0} WHERE label = 0) n)"""
AP = """(SELECT sum(pos * tp / (tp + fp)) / max(total) FROM (
  SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS total FROM (
    SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {0} GROUP BY 1)
  WINDOW w AS (ORDER BY score DESC)))"""
BINS = """(SELECT bin, min(score) AS lower, max(score) AS upper, avg(score) AS mean_score, avg(label) AS observed_rate,
  count(*) AS count FROM (SELECT *, CAST(ntile(10) OVER (ORDER BY score, encounter_id) AS INTEGER) AS bin FROM {0}) GROUP BY 1)"""
ECE = "(SELECT sum(count * abs(mean_score - observed_rate)) / sum(count) FROM " + BINS + ")"
HOLDOUT = f", holdout AS (SELECT * FROM scored WHERE {holdout_sql()})"


def holdout(spark, d):
    key = (spark.sparkContext.applicationId, d, "holdout")
    if key not in common._TABLES:
        kept = common.scored(spark, d).filter(is_holdout(F.col("patient_id"), 0.2, SPLIT_SEED))
        common._TABLES[key] = materialize(kept)
    return common._TABLES[key]


@query("auroc", f"SELECT count(*) AS rows, round({PAIRS.format('scored')}, 9) AS auroc FROM scored")
def auroc(spark, d):
    return ranking(common.scored(spark, d)).select("rows", F.round("auroc", 9).alias("auroc"))


@query("pr_auc", f"SELECT round({AP.format('scored')}, 9) AS pr_auc")
def pr_auc(spark, d):
    return ranking(common.scored(spark, d)).select(F.round("pr_auc", 9).alias("pr_auc"))


@query("brier", "SELECT round(avg((score - label) * (score - label)), 9) AS brier FROM scored")
def brier_score(spark, d):
    return common.scored(spark, d).agg(F.round(brier(), 9).alias("brier"))


@query("equal_count_bins", "SELECT encounter_id, CAST(ntile(10) OVER (ORDER BY score, encounter_id) AS INTEGER) AS bin FROM scored")
def equal_count_bins(spark, d):
    ranked = with_row_number(common.scored(spark, d), ["score", "encounter_id"], "r", total="n")
    return ranked.select("encounter_id", bin_of(F.col("r"), F.col("n"), 10).alias("bin"))


@query("calibration", f"SELECT bin, lower, upper, round(mean_score, 9) AS mean_score, round(observed_rate, 9) AS observed_rate, "
       f"count FROM {BINS.format('scored')}")
def calibration_table(spark, d):
    return calibration(common.scored(spark, d), "encounter_id").withColumns(
        {"mean_score": F.round("mean_score", 9), "observed_rate": F.round("observed_rate", 9), "count": F.col("count").cast("long")}
    )


@query("ece", f"SELECT round({ECE.format('scored')}, 9) AS ece")
def ece(spark, d):
    return calibration_error(calibration(common.scored(spark, d), "encounter_id")).select(F.round("ece", 9).alias("ece"))


# The Poisson laws by level, as far as any table here needs them.
LAWS = "CASE level " + " ".join(f"WHEN {j} THEN {[float(t) for t in poisson_bounds(j)]}" for j in range(16)) + " END"
DRAWS = HOLDOUT + f"""
, entities AS (SELECT patient_id, row_number() OVER (ORDER BY CAST(patient_id AS VARCHAR)) AS idx, count(*) OVER () AS n
               FROM (SELECT DISTINCT patient_id FROM holdout)),
law AS (SELECT n, {LAWS} AS bounds FROM (SELECT max(n) AS n, greatest(0, floor(log2(greatest(1, sqrt(max(n)) / 6)))) AS level FROM entities)),
digests AS (SELECT patient_id, b, sha256('{BOOTSTRAP_SEED}/' || patient_id || '/' || b) AS h
            FROM entities, range({-(-REPLICATES // WORDS)}) r(b)),
own AS (SELECT patient_id, CAST({WORDS} * b + k AS INTEGER) AS replicate,
               len(list_filter(bounds, lambda t: t <= CAST('0x' || substr(h, 1 + 8 * k, 8) AS BIGINT))) AS weight
        FROM digests, range({WORDS}) r(k), law WHERE {WORDS} * b + k < {REPLICATES}),
missing AS (SELECT replicate, n, sum(weight) > n AS anew, CASE WHEN sum(weight) > n THEN n ELSE n - sum(weight) END AS m
            FROM own, law GROUP BY replicate, n),
extra AS (SELECT replicate, CAST(floor({UNIFORM.format(f"'{BOOTSTRAP_SEED}/extra/' || replicate || '/' || slot")} * n) AS BIGINT) + 1 AS idx
          FROM missing, LATERAL (SELECT unnest(range(CAST(m AS BIGINT))) AS slot)),
weights AS (SELECT patient_id, replicate, CAST(sum(weight) AS BIGINT) AS weight FROM (
  SELECT patient_id, replicate, CASE WHEN anew THEN 0 ELSE weight END AS weight FROM own JOIN missing USING (replicate)
  UNION ALL SELECT patient_id, replicate, 1 FROM extra JOIN entities USING (idx)) GROUP BY ALL),
resampled AS (SELECT w.replicate, h.encounter_id, h.score, h.label, w.weight FROM holdout h JOIN weights w USING (patient_id) WHERE weight > 0),
by_score AS (SELECT replicate, score, sum(weight * label) AS pos, sum(weight * (1 - label)) AS neg FROM resampled GROUP BY 1, 2),
ranked AS (SELECT *, sum(neg) OVER (PARTITION BY replicate ORDER BY score) - neg AS below,
                  sum(pos) OVER d AS tp, sum(neg) OVER d AS fp FROM by_score
           WINDOW d AS (PARTITION BY replicate ORDER BY score DESC)),
rank_metrics AS (SELECT replicate, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auroc,
                        sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc
                 FROM ranked GROUP BY 1 HAVING sum(pos) > 0 AND sum(neg) > 0),
copies AS (SELECT replicate, encounter_id, score, label, unnest(range(weight)) AS c FROM resampled),
dealt AS (SELECT *, ntile(10) OVER (PARTITION BY replicate ORDER BY score, encounter_id, c) AS bin FROM copies),
eces AS (SELECT replicate, sum(k * abs(s - y)) / sum(k) AS ece FROM
  (SELECT replicate, bin, count(*) AS k, avg(score) AS s, avg(label) AS y FROM dealt GROUP BY 1, 2) GROUP BY 1),
losses AS (SELECT replicate, sum(weight * (score - label) * (score - label)) / sum(weight) AS brier FROM resampled GROUP BY 1),
replicates AS (SELECT * FROM rank_metrics JOIN eces USING (replicate) JOIN losses USING (replicate))
"""


# One row an entity: its thousand weights as a digest, with what they add up to.
@query("bootstrap_weights", DRAWS + """SELECT patient_id, sum(weight)::BIGINT AS drawn, count(*) FILTER (WHERE weight > 0) AS replicates,
  sha256(string_agg(weight, ',' ORDER BY replicate)) AS weights_sha256 FROM weights GROUP BY 1""")
def bootstrap_weights(spark, d):
    return entity_weights(holdout(spark, d).select("patient_id"), REPLICATES, BOOTSTRAP_SEED).select(
        "patient_id", F.expr("aggregate(weights, 0L, (a, w) -> a + w)").alias("drawn"),
        F.size(F.filter("weights", lambda w: w > 0)).cast("long").alias("replicates"),
        F.sha2(F.array_join("weights", ","), 256).alias("weights_sha256"),
    )


INTERVAL = """SELECT '{0}' AS metric, round({1}, 9) AS value, round(quantile_cont({0}, 0.025), 9) AS ci_low,
  round(quantile_cont({0}, 0.975), 9) AS ci_high, count(*) AS replicates_used FROM replicates"""


@query("bootstrap_intervals", DRAWS + " UNION ALL ".join([
    INTERVAL.format("auroc", PAIRS.format("holdout")), INTERVAL.format("pr_auc", AP.format("holdout")),
    INTERVAL.format("ece", ECE.format("holdout")),
    INTERVAL.format("brier", "(SELECT avg((score - label) * (score - label)) FROM holdout)"),
]))
def intervals(spark, d):
    out = bootstrap_intervals(
        holdout(spark, d), entity="patient_id", row_id="encounter_id", replicates=REPLICATES, seed=BOOTSTRAP_SEED
    )
    return out.withColumns({c: F.round(c, 9) for c in ("value", "ci_low", "ci_high")})


MEMBERS = """
, members AS (SELECT s.*, unnest(list_filter([
   CASE WHEN age_at_discharge >= 18 AND age_at_discharge < 50 THEN 'age_18_49' END,
   CASE WHEN age_at_discharge >= 50 AND age_at_discharge < 65 THEN 'age_50_64' END,
   CASE WHEN age_at_discharge >= 65 AND age_at_discharge < 80 THEN 'age_65_79' END,
   CASE WHEN age_at_discharge >= 80 THEN 'age_80_plus' END, CASE WHEN gender = 'M' THEN 'sex_male' END,
   CASE WHEN gender = 'F' THEN 'sex_female' END, CASE WHEN flag_chf = 1 THEN 'flag_chf' END,
   CASE WHEN flag_chronic_pulmonary = 1 THEN 'flag_chronic_pulmonary' END, CASE WHEN flag_dementia = 1 THEN 'flag_dementia' END,
   CASE WHEN flag_diabetes = 1 THEN 'flag_diabetes' END, CASE WHEN flag_malignancy = 1 THEN 'flag_malignancy' END,
   CASE WHEN flag_mi = 1 THEN 'flag_mi' END, CASE WHEN flag_renal_disease = 1 THEN 'flag_renal_disease' END],
   lambda x: x IS NOT NULL)) AS name FROM scored s LEFT JOIN patients p ON p.id = s.patient_id)
"""


@query("subgroup_membership", MEMBERS + "SELECT encounter_id, name FROM members")
def subgroup_membership(spark, d):
    return subgroup_rows(common.scored(spark, d), testdata.patients(spark, d)).select(
        "encounter_id", F.col("subgroup").alias("name")
    )


@query("subgroup_metrics", MEMBERS + """
, sizes AS (SELECT name, count(*) AS n_rows, count(DISTINCT patient_id) AS n_patients, avg(label) AS prevalence,
                   sum(label) AS pos, count(*) - sum(label) AS neg FROM members GROUP BY 1),
pairs AS (SELECT p.name, sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS wins
          FROM members p JOIN members n ON n.name = p.name AND n.label = 0 WHERE p.label = 1 GROUP BY 1)
SELECT n.name, coalesce(n_rows, 0) AS n_rows, coalesce(n_patients, 0) AS n_patients, round(prevalence, 9) AS prevalence,
       CASE WHEN n_rows >= 50 AND pos > 0 AND neg > 0 THEN round(wins / (pos * neg), 9) END AS auroc,
       CASE WHEN coalesce(n_rows, 0) < 50 THEN 'under_50_rows:' || coalesce(n_rows, 0)
            WHEN pos = 0 OR neg = 0 THEN 'one_label' ELSE '' END AS note
FROM (SELECT unnest(['age_18_49', 'age_50_64', 'age_65_79', 'age_80_plus', 'sex_male', 'sex_female', 'flag_chf',
  'flag_chronic_pulmonary', 'flag_dementia', 'flag_diabetes', 'flag_malignancy', 'flag_mi', 'flag_renal_disease']) AS name) n
LEFT JOIN sizes s ON s.name = n.name LEFT JOIN pairs p ON p.name = n.name""")
def subgroups(spark, d):
    return subgroup_metrics(common.scored(spark, d), testdata.patients(spark, d)).withColumns(
        {c: F.round(c, 9) for c in ("prevalence", "auroc")}
    )


CHECKS = f"""{HOLDOUT}
, m AS (SELECT {PAIRS.format('holdout')} AS auroc, {ECE.format('holdout')} AS ece),
checks AS (SELECT 'auroc_above_band_floor' AS name, auroc >= 0.65 AS passed, auroc AS value, 0.65 AS threshold FROM m
  UNION ALL SELECT 'auroc_below_band_ceiling', auroc <= 0.92, auroc, 0.92 FROM m
  UNION ALL SELECT 'ece_within_threshold', ece <= 0.05, ece, 0.05 FROM m
  UNION ALL SELECT 'holdout_reproduced', abs(auroc - 0.6) <= 1e-6, abs(auroc - 0.6), 1e-6 FROM m)
"""


def _checks(spark, d):
    rows = holdout(spark, d)
    ranked = ranking(rows).select("auroc", F.lit(1).alias("one"))
    gaps = calibration_error(calibration(rows, "encounter_id")).select("ece", F.lit(1).alias("one"))
    return gate_checks(ranked.join(gaps, "one"), expected_auroc=0.6)


@query("gate_checks", CHECKS + "SELECT name, passed, round(value, 9) AS value, CAST(threshold AS DOUBLE) AS threshold FROM checks")
def checks(spark, d):
    return _checks(spark, d).select("name", "passed", F.round("value", 9).alias("value"), "threshold")


@query("gate_verdict", CHECKS + "SELECT CASE WHEN bool_and(passed) THEN 'pass' ELSE 'fail' END AS verdict FROM checks")
def gate_verdict(spark, d):
    return verdict(_checks(spark, d))


# The whole gate over the holdout: every check and metric, the size of the holdout and the verdict in one table.
GATE_METRICS = {"auroc": PAIRS, "pr_auc": AP, "ece": ECE, "brier": "(SELECT avg((score - label) * (score - label)) FROM {0})"}


@query("gate_report", DRAWS + CHECKS.removeprefix(HOLDOUT) + "".join(
    f"SELECT 'metric' AS section, '{m}' AS name, round({sql.format('holdout')}, 9) AS value, round(quantile_cont({m}, 0.025), 9) AS low, "
    f"round(quantile_cont({m}, 0.975), 9) AS high, NULL::BOOLEAN AS passed FROM replicates UNION ALL " for m, sql in GATE_METRICS.items()
) + """SELECT 'check', name, round(value, 9), CAST(threshold AS DOUBLE), NULL, passed FROM checks
UNION ALL SELECT 'holdout', 'rows', count(*)::DOUBLE, NULL, NULL, NULL FROM holdout
UNION ALL SELECT 'holdout', 'patients', count(DISTINCT patient_id)::DOUBLE, NULL, NULL, NULL FROM holdout
UNION ALL SELECT 'holdout', 'prevalence', round(avg(label), 9), NULL, NULL, NULL FROM holdout
UNION ALL SELECT 'verdict', 'pass', NULL, NULL, NULL, bool_and(passed) FROM checks""")
def gate_report(spark, d):
    result = evaluate(holdout(spark, d), testdata.patients(spark, d), expected_auroc=0.6)
    line = lambda df, section, name, value, low=None, high=None, passed=None: df.select(
        F.lit(section).alias("section"), name.alias("name"), F.round(value, 9).alias("value"),
        (F.lit(None).cast("double") if low is None else low).alias("low"), (F.lit(None).cast("double") if high is None else high).alias("high"),
        (F.lit(None).cast("boolean") if passed is None else passed).alias("passed"),
    )
    none = F.lit(None).cast("double")
    parts = [
        line(result.metrics, "metric", F.col("metric"), F.col("value"), F.round("ci_low", 9), F.round("ci_high", 9)),
        line(result.checks, "check", F.col("name"), F.col("value"), F.col("threshold"), passed=F.col("passed")),
        *[line(result.totals, "holdout", F.lit(n), F.col(c).cast("double")) for n, c in (("rows", "n_rows"), ("patients", "n_patients"), ("prevalence", "prevalence"))],
        line(result.verdict, "verdict", F.lit("pass"), none, passed=F.col("verdict") == "pass"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("batch_scores", "SELECT encounter_id, score, label FROM scored")
def batch_scores(spark, d):
    return common.scored(spark, d).select("encounter_id", "score", "label")


@query("median_row", "SELECT encounter_id, score FROM (SELECT *, row_number() OVER (ORDER BY score, encounter_id) - 1 AS r, "
       "count(*) OVER () AS n FROM scored WHERE stop >= TIMESTAMP '1999-01-01') WHERE r = n // 2")
def median(spark, d):
    return median_row(common.scored(spark, d).filter("stop >= timestamp'1999-01-01'")).select("encounter_id", "score")
