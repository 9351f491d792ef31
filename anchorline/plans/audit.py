"""Reconciliation and audit of logs against the batch pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.contracts import LABEL_WINDOW_DAYS
from anchorline.functions.hashing import payload_hash
from anchorline.functions.scalar import due_at
from anchorline.operators.joins import missing_rows
from anchorline.operators.metrics import ranking
from anchorline.operators.rank import with_row_number


def partition_log(cohort: DataFrame, logged: DataFrame, cutoff: str) -> DataFrame:
    """Every cohort anchor and logged prediction in one bucket.

    held_out and pre_cutoff are logged anchors by side of the cutoff, unscored an anchor the log
    lacks, unexpected a logged row no anchor explains.
    """
    expected = cohort.select("encounter_id", (F.col("stop") >= F.lit(cutoff).cast("timestamp")).alias("_held_out"))
    seen = logged.select("encounter_id", F.lit(True).alias("_seen"))
    bucket = (
        F.when(F.col("_seen").isNull(), "unscored")
        .when(F.col("_held_out").isNull(), "unexpected")
        .when(F.col("_held_out"), "held_out")
        .otherwise("pre_cutoff")
    )
    return expected.join(seen, "encounter_id", "full").select("encounter_id", bucket.alias("bucket"))


def median_row(rows: DataFrame, encounter_id=None) -> DataFrame:
    """The row at position ``n div 2`` in (score, encounter_id) order, or a named one."""
    if encounter_id is not None:
        return rows.filter(F.col("encounter_id") == F.lit(encounter_id))
    ranked = with_row_number(rows, ["score", "encounter_id"], "_r", total="_n")
    return ranked.filter(F.col("_r") - 1 == F.expr("_n div 2")).drop("_r", "_n")


def joined_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions with their released label, one to one."""
    return predictions.join(labels.select("prediction_id", "label", "due_at", "released_at"), "prediction_id")


def performance(rows: DataFrame) -> DataFrame:
    """Count, prevalence and AUROC of scored, labelled rows; NULL where undefined, never an error."""
    totals = rows.agg(F.count("*").alias("count"), F.avg("label").alias("prevalence"), F.lit(1).alias("_one"))
    auc = ranking(rows).select("auroc", F.lit(1).alias("_one"))
    return totals.join(auc, "_one", "left").drop("_one")


def realized_performance(predictions: DataFrame, labels: DataFrame, start: str, end: str) -> DataFrame:
    """Performance over the labelled discharges in ``[start, end)``."""
    joined = joined_labels(predictions, labels)
    window = joined.filter(in_window("event_time", start, end))
    return performance(window.select("score", "label"))


def in_window(column: str, start: str, end: str) -> Column:
    """Start included, end not; a window without an instant in it is refused."""
    if not start < end:
        raise ValueError(f"[{start}, {end}) would end at or before its first instant")
    at = F.col(column)
    return (at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp"))


def batch_performance(scored: DataFrame, start: str, end: str) -> DataFrame:
    """The same numbers from batch features, labels and scores; must equal the realized ones."""
    return performance(scored.filter(in_window("stop", start, end)).select("score", "label"))


def label_audit(released: DataFrame, expected: DataFrame) -> DataFrame:
    """Released labels that differ from the batch label, or have none."""
    batch = expected.select("encounter_id", F.col("label").alias("expected"))
    return released.join(batch, "encounter_id", "left").filter(
        ~F.col("label").eqNullSafe(F.col("expected"))
    ).select("encounter_id", "label", "expected")


def early_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Count of releases before the end of the label window (0 in a sound log)."""
    early = F.col("released_at") < due_at("event_time", LABEL_WINDOW_DAYS)
    return joined_labels(predictions, labels).agg(F.count_if(early).alias("early"))


def unlabelled(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions without a label: how many, and the earliest discharge among them."""
    rest = missing_rows(predictions, labels, ["prediction_id"])
    return rest.agg(F.count("*").alias("unlabelled"), F.min("event_time").alias("earliest"))


def unscored(cohort: DataFrame, predictions: DataFrame) -> DataFrame:
    """Admitted discharges without a prediction."""
    return missing_rows(cohort, predictions, ["encounter_id"])


def logged_models(predictions: DataFrame) -> DataFrame:
    return predictions.select("model_name", "model_version").distinct()


def logged_model(predictions: DataFrame) -> tuple[str, int]:
    """Name and version of the model that wrote a log of exactly one model."""
    named = F.struct("model_name", "model_version")
    ends = predictions.agg(F.min(named).alias("low"), F.max(named).alias("high")).first()
    if ends["low"] is None:
        raise LookupError("no logged prediction to take a model from")
    if ends["low"] != ends["high"]:
        raise RuntimeError(f"logged by several models, from {tuple(ends['low'])} to {tuple(ends['high'])}")
    return tuple(ends["low"])


def acknowledged_mismatches(acknowledged: DataFrame, logged: DataFrame) -> DataFrame:
    """Encounters whose acknowledged hash or score differs from the stored one."""
    a = acknowledged.select("encounter_id", F.struct("input_hash", "score").alias("_a"))
    b = logged.select("encounter_id", F.struct("input_hash", "score").alias("_b"))
    return a.join(b, "encounter_id").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("encounter_id")


def source_hashes(raw_encounters: DataFrame) -> DataFrame:
    """The input hash of every source encounter, as scoring would have stored it."""
    columns = ("Id", "START", "STOP", "PATIENT", "ENCOUNTERCLASS")
    return raw_encounters.select(
        F.col("Id").alias("encounter_id"), payload_hash("encounter", {c: F.col(c) for c in columns}).alias("recomputed_hash")
    )


def verify_predictions(predictions: DataFrame, raw_encounters: DataFrame, rescored: DataFrame) -> DataFrame:
    """Each prediction with its recomputed hash and score and whether both match exactly.

    ``rescored`` has ``encounter_id`` and ``rescored`` from the logged features. A prediction
    without a source row gets ``has_source`` false.
    """
    sources = source_hashes(raw_encounters).withColumn("_source", F.lit(True))
    joined = predictions.join(sources, "encounter_id", "left").join(rescored, "encounter_id", "left")
    return joined.select(
        "encounter_id",
        "prediction_id",
        F.col("input_hash").alias("logged_hash"),
        "recomputed_hash",
        F.col("score").alias("logged_score"),
        "rescored",
        F.coalesce("_source", F.lit(False)).alias("has_source"),
        F.coalesce(F.col("input_hash") == F.col("recomputed_hash"), F.lit(False)).alias("hash_matches"),
        F.coalesce(F.col("score") == F.col("rescored"), F.lit(False)).alias("score_matches"),
        F.abs(F.col("score") - F.col("rescored")).alias("gap"),
    )


def missing_features(predictions: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Predictions whose logged feature map lacks a model input or holds NaN, with the names."""
    lacking = F.array_compact(F.array(*[
        F.when(F.col("features")[n].isNull() | F.isnan(F.col("features")[n]), F.lit(n)) for n in names
    ]))
    return predictions.select("encounter_id", lacking.alias("missing")).filter(F.size("missing") > 0)


class MissingFeature(LookupError):
    """A logged prediction cannot be rescored: its feature map lacks a model input."""


def verify_log(predictions: DataFrame, raw_encounters: DataFrame, score: Callable[[DataFrame], DataFrame], names: tuple[str, ...]) -> DataFrame:
    """``verify_predictions`` with scores made anew from the features as the log holds them.

    ``score`` adds a ``score`` column to rows of model inputs. A prediction whose map lacks one of ``names``, or holds
    NaN for it, raises: filling it in would prove nothing.
    """
    lacking = missing_features(predictions, names).orderBy("encounter_id").take(5)
    if lacking:
        raise MissingFeature(f"logged features are missing, among them {[(r['encounter_id'], r['missing']) for r in lacking]}")
    again = predictions.select("encounter_id", *[F.col("features")[n].alias(n) for n in names])
    return verify_predictions(predictions, raw_encounters, score(again).select("encounter_id", F.col("score").alias("rescored")))


def serving_skew(streamed: DataFrame, batch: DataFrame) -> DataFrame:
    """Discharges whose streamed features differ from the batch ones, with the columns; exact."""
    from anchorline.operators.joins import keyed_difference

    return keyed_difference(streamed.select(*batch.columns), batch, ["encounter_id"])


def score_gaps(checks: DataFrame) -> DataFrame:
    """Rows whose score did not reproduce, with the absolute gap and its distance in doubles."""
    from anchorline.functions.ulps import ulp_distance

    broken = checks.filter(~F.col("score_matches") & F.col("rescored").isNotNull())
    return broken.select("encounter_id", "gap", ulp_distance(F.col("logged_score"), F.col("rescored")).alias("ulps"))
