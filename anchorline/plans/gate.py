"""The evaluation gate: metrics with intervals, checks against fixed bands, subgroup report, verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.contracts import (
    AGE_BANDS, BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED, ECE_LIMIT, FLAGS, REPRODUCTION_TOLERANCE, SIGNAL_BAND,
    SUBGROUP_MIN_ROWS,
)
from anchorline.operators.bootstrap import bootstrap_intervals
from anchorline.operators.joins import checked_lookup
from anchorline.operators.metrics import calibration, ranking

SUBGROUPS = (*[name for name, _, _ in AGE_BANDS], "sex_male", "sex_female", *FLAGS)


def memberships() -> Column:
    """Names of the subgroups a feature row with ``gender`` belongs to."""
    age = F.col("age_at_discharge").cast("int")
    tests = [F.when((age >= low) & (F.lit(True) if high is None else age < high), F.lit(name))
             for name, low, high in AGE_BANDS]
    tests += [F.when(F.col("gender") == "M", F.lit("sex_male")), F.when(F.col("gender") == "F", F.lit("sex_female"))]
    tests += [F.when(F.col(flag) == 1, F.lit(flag)) for flag in FLAGS]
    return F.array_compact(F.array(*tests))


def subgroup_rows(rows: DataFrame, patients: DataFrame) -> DataFrame:
    """One row per scored row and subgroup it belongs to; unknown sex joins neither."""
    people = patients.select(F.col("id").alias("patient_id"), "gender")
    return checked_lookup(rows, people, ["patient_id"]).withColumn("subgroup", F.explode(memberships()))


def subgroup_metrics(rows: DataFrame, patients: DataFrame, min_rows: int = SUBGROUP_MIN_ROWS) -> DataFrame:
    """Rows, patients, prevalence and AUROC per subgroup; small or one-class groups get a note instead."""
    long = subgroup_rows(rows, patients).select("subgroup", "patient_id", "score", "label")
    sizes = long.groupBy("subgroup").agg(F.countDistinct("patient_id").alias("n_patients"))
    names = rows.sparkSession.createDataFrame([(n,) for n in SUBGROUPS], "subgroup string")
    joined = names.join(ranking(long, ["subgroup"]).join(sizes, "subgroup"), "subgroup", "left")
    n = F.coalesce("rows", F.lit(0))
    note = (
        F.when(n < min_rows, F.format_string(f"under_{min_rows}_rows:%d", n))
        .when(F.col("auroc").isNull(), F.lit("one_label"))
        .otherwise(F.lit(""))
    )
    return joined.select(
        F.col("subgroup").alias("name"), n.alias("n_rows"), F.coalesce("n_patients", F.lit(0)).alias("n_patients"),
        "prevalence", F.when(n >= min_rows, F.col("auroc")).alias("auroc"), note.alias("note"),
    )


def gate_checks(metrics: DataFrame, expected_auroc: float | None = None) -> DataFrame:
    """One row per criterion: name, passed, value, threshold, detail.

    ``metrics`` is one row with ``auroc`` and ``ece``.
    """
    floor, ceiling = SIGNAL_BAND
    auroc, ece = F.col("auroc"), F.col("ece")
    # name, value, the side the limit must be on, limit, what a failure suggests
    rules = [
        ("auroc_above_band_floor", auroc, ">=", floor, "no_signal"),
        ("auroc_below_band_ceiling", auroc, "<=", ceiling, "leakage"),
        ("ece_within_threshold", ece, "<=", ECE_LIMIT, "miscalibrated"),
    ]
    if expected_auroc is not None:
        rules.append(("holdout_reproduced", F.abs(auroc - F.lit(expected_auroc)), "<=", REPRODUCTION_TOLERANCE, "not_reproduced"))
    rows = []
    for name, value, sign, limit, hint in rules:
        good = value >= limit if sign == ">=" else value <= limit
        told = F.format_string(f"%.6f {sign} {limit}: %s", value, F.when(good, "holds").otherwise(hint))
        rows.append((name, good, value, limit, told))
    packed = F.array(*[
        F.struct(F.lit(n).alias("name"), F.coalesce(p, F.lit(False)).alias("passed"), v.cast("double").alias("value"),
                 F.lit(float(t)).alias("threshold"), d.alias("detail"))
        for n, p, v, t, d in rows
    ])
    return metrics.select(F.explode(packed).alias("c")).select("c.*")


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.when(F.bool_and("passed"), "pass").otherwise("fail").alias("verdict"))


@dataclass(frozen=True)
class GateResult:
    """The gate's small result tables."""

    metrics: DataFrame
    checks: DataFrame
    calibration: DataFrame
    subgroups: DataFrame
    totals: DataFrame
    verdict: DataFrame


def evaluate(
    holdout: DataFrame,
    patients: DataFrame,
    *,
    expected_auroc: float | None = None,
    replicates: int = BOOTSTRAP_REPLICATES,
    seed: int = BOOTSTRAP_SEED,
    min_rows: int = SUBGROUP_MIN_ROWS,
) -> GateResult:
    """Judge held-out rows (feature columns, ``score``, ``label``).

    Every table reads the holdout, so pass a materialized one.
    """
    intervals = bootstrap_intervals(
        holdout, entity="patient_id", row_id="encounter_id", replicates=replicates, seed=seed
    )
    wide = intervals.groupBy().pivot("metric", ["auroc", "ece"]).agg(F.max("value"))
    checks = gate_checks(wide, expected_auroc)
    return GateResult(
        metrics=intervals,
        checks=checks,
        calibration=calibration(holdout, "encounter_id"),
        subgroups=subgroup_metrics(holdout, patients, min_rows),
        totals=holdout.agg(
            F.count("*").alias("n_rows"), F.countDistinct("patient_id").alias("n_patients"),
            F.avg("label").alias("prevalence"),
        ),
        verdict=verdict(checks),
    )


def write_result(result: GateResult, path: str) -> None:
    for name in ("metrics", "checks", "calibration", "subgroups", "totals", "verdict"):
        getattr(result, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def _markdown(df: DataFrame, order: str | None = None) -> list[str]:
    ordered = df.orderBy(order) if order else df
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else ("" if v is None else str(v))
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    # Bounded: one row per metric, check, bin or subgroup.
    return lines + ["| " + " | ".join(show(v) for v in row) + " |" for row in ordered.collect()]


def render_report(result: GateResult, title: dict[str, str]) -> str:
    """The gate's outcome as Markdown."""
    decided = result.verdict.first()["verdict"]
    lines = [f"# Gate report: {decided.upper()}", ""]
    lines += [f"- {k}: {v}" for k, v in title.items()] + [""]
    for heading, table, order in (
        ("Holdout", result.totals, None), ("Checks", result.checks, None), ("Metrics", result.metrics, "metric"),
        ("Calibration", result.calibration, "bin"), ("Subgroups", result.subgroups, "name"),
    ):
        lines += [f"## {heading}", "", *_markdown(table, order), ""]
    return "\n".join(lines)

