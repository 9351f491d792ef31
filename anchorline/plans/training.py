"""Train, score, record and gate a model version on the batch plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorline.contracts import (
    BOOTSTRAP_REPLICATES, COHORT_VERSION, FEATURE_VERSION, HOLDOUT_FRACTION, LABEL_VERSION, MODEL_INPUTS, MODEL_NAME,
    SPLIT_SEED, SUBGROUP_MIN_ROWS, TRAINING_CUTOFF,
)
from anchorline.operators.metrics import ranking
from anchorline.operators.sampling import is_holdout
from anchorline.plans.cohort import build_cohort, training_window
from anchorline.plans.gate import GateResult, evaluate
from anchorline.plans.labels import build_training_rows
from anchorline.session import materialize

RUN_SCHEMA = (
    "run_id STRING, model_name STRING, model_version INT, path STRING, training_cutoff STRING, split_seed BIGINT, "
    "holdout_fraction DOUBLE, cohort_version STRING, feature_version STRING, label_version STRING, "
    "params MAP<STRING, STRING>, metrics MAP<STRING, DOUBLE>, recorded_at TIMESTAMP"
)


def inputs_as_doubles(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in MODEL_INPUTS})


def fit(rows: DataFrame, *, rounds: int = 300, depth: int = 5, step: float = 0.05, seed: int = SPLIT_SEED) -> PipelineModel:
    """Boosted trees on the 14 model inputs with fixed parameters."""
    assembler = VectorAssembler(inputCols=list(MODEL_INPUTS), outputCol="_features")
    trees = GBTClassifier(
        featuresCol="_features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.9,
        featureSubsetStrategy="0.9", minInstancesPerNode=20, seed=seed % 2**31, checkpointInterval=10,
    )
    return Pipeline(stages=[assembler, trees]).fit(inputs_as_doubles(rows))


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the model's probability as ``score``."""
    scored = model.transform(inputs_as_doubles(rows))
    added = ["_features", "rawPrediction", "probability", "prediction"]
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(*added)


@dataclass(frozen=True)
class Registry:
    """Model versions and run records as append-only tables in one folder."""

    spark: SparkSession
    path: str

    def runs(self) -> DataFrame:
        try:
            return self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/runs")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], RUN_SCHEMA)

    def latest_version(self, name: str = MODEL_NAME) -> int:
        found = self.runs().filter(F.col("model_name") == name).agg(F.max("model_version")).first()[0]
        return found or 0

    def register(self, model: PipelineModel, record: dict, name: str = MODEL_NAME) -> int:
        version = self.latest_version(name) + 1
        while True:
            location = f"{self.path}/models/{name}/{version}"
            try:
                # A folder is made once, so of two trainers only one gets a number.
                model.save(location)
                break
            except Exception as taken:
                if "already exists" not in str(taken):
                    raise
                version += 1
        row = {**record, "run_id": f"{name}-{version}", "model_name": name, "model_version": version, "path": location}
        columns = [c.split()[0] for c in RUN_SCHEMA.replace("MAP<STRING, STRING>", "M").replace("MAP<STRING, DOUBLE>", "M").split(", ")]
        one = self.spark.createDataFrame([tuple(row.get(c) for c in columns)], RUN_SCHEMA)
        one.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/runs")
        return version

    def record(self, version: int, name: str = MODEL_NAME):
        found = self.runs().filter((F.col("model_name") == name) & (F.col("model_version") == version)).first()
        if found is None:
            raise LookupError(f"model {name!r} version {version} is not registered")
        return found

    def load(self, version: int, name: str = MODEL_NAME) -> PipelineModel:
        return PipelineModel.load(self.record(version, name)["path"])


def training_rows(frames: dict[str, DataFrame], cutoff: str) -> DataFrame:
    """Features and label of every cohort discharge before the cutoff."""
    cohort = training_window(build_cohort(frames["encounters"], frames["patients"]), cutoff)
    return build_training_rows(frames, cohort)


def split(rows: DataFrame, fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    held = is_holdout(F.col("patient_id"), fraction, seed)
    return rows.filter(~held), rows.filter(held)


def train(
    frames: dict[str, DataFrame],
    registry: Registry,
    *,
    cutoff: str = TRAINING_CUTOFF,
    seed: int = SPLIT_SEED,
    fraction: float = HOLDOUT_FRACTION,
    rounds: int = 300,
) -> int:
    """Fit on the training side, measure on the holdout, register; the new version."""
    rows = materialize(training_rows(frames, cutoff))
    training, holdout = split(rows, fraction, seed)
    model = fit(training, rounds=rounds, seed=seed)
    measured = ranking(score(model, holdout)).first()
    sizes = rows.groupBy(is_holdout(F.col("patient_id"), fraction, seed).alias("held")).agg(
        F.count("*").alias("rows"), F.countDistinct("patient_id").alias("patients")
    )
    # Two rows.
    by_side = {r["held"]: r for r in sizes.collect()}
    metrics = {"holdout_auroc": measured["auroc"], "holdout_pr_auc": measured["pr_auc"], "holdout_prevalence": measured["prevalence"]}
    for held, side in ((False, "train"), (True, "holdout")):
        metrics[f"n_{side}_rows"] = float(by_side[held]["rows"]) if held in by_side else 0.0
        metrics[f"n_{side}_patients"] = float(by_side[held]["patients"]) if held in by_side else 0.0
    return registry.register(model, {
        "training_cutoff": cutoff, "split_seed": seed, "holdout_fraction": fraction, "cohort_version": COHORT_VERSION,
        "feature_version": FEATURE_VERSION, "label_version": LABEL_VERSION, "params": {"rounds": str(rounds)},
        "metrics": metrics,
    })


def run_gate(
    frames: dict[str, DataFrame],
    registry: Registry,
    version: int | None = None,
    *,
    replicates: int = BOOTSTRAP_REPLICATES,
    min_rows: int = SUBGROUP_MIN_ROWS,
) -> GateResult:
    """Rebuild the version's holdout from its own record and judge it."""
    version = registry.latest_version() if version is None else version
    run = registry.record(version)
    rows = training_rows(frames, run["training_cutoff"])
    _, holdout = split(rows, run["holdout_fraction"], run["split_seed"])
    scored = materialize(score(registry.load(version), holdout))
    return evaluate(
        scored, frames["patients"], expected_auroc=run["metrics"]["holdout_auroc"], replicates=replicates, min_rows=min_rows
    )


def retrain(frames: dict[str, DataFrame], registry: Registry, **options) -> tuple[int, GateResult, bool]:
    """Train a candidate, gate that very version; a failed one stays registered."""
    gate_options = {k: options.pop(k) for k in ("replicates", "min_rows") if k in options}
    version = train(frames, registry, **options)
    result = run_gate(frames, registry, version, **gate_options)
    return version, result, result.verdict.first()["verdict"] == "pass"
