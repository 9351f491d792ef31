"""The monitoring reference of a model version: training-window features and holdout scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorline.contracts import MODEL_INPUTS
from anchorline.operators.monitor import long_form
from anchorline.operators.sampling import is_holdout


def build_reference(scored: DataFrame, *, cutoff: str, fraction: float, seed: int) -> DataFrame:
    """``signal`` and ``value`` rows of one version.

    Features span every row discharged before the cutoff; scores come from the entity-grouped
    holdout only, since in-sample scores would make live drift read low.
    """
    window = scored.filter(F.col("stop") < F.lit(cutoff).cast("timestamp"))
    # One pass: a training row contributes its features and, if held out, its score.
    held = is_holdout(F.col("patient_id"), fraction, seed)
    marked = window.withColumn("score", F.when(held, F.col("score")))
    return long_form(marked, (*MODEL_INPUTS, "score")).filter(F.col("value").isNotNull())


def export_arrays(reference: DataFrame) -> DataFrame:
    """The reference as one map of value arrays, for small exports only."""
    arrays = reference.groupBy("signal").agg(F.sort_array(F.collect_list("value")).alias("values"))
    return arrays.agg(F.map_from_entries(F.collect_list(F.struct("signal", "values"))).alias("features"))
