"""Ranking, calibration and summary metrics of scored rows.

Inputs have ``score``, ``label`` (0/1) and, where stated, a row id and an integer ``weight``.
``groups`` computes the metric for every group at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.contracts import CALIBRATION_BINS
from anchorline.operators.rank import bin_end, bin_of, exact_quantiles, running_totals


def ranking(df: DataFrame, groups: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """AUROC (ties count half) and average precision, with row counts and prevalence.

    Both are NULL where only one class is present.
    """
    groups = list(groups or [])
    w = F.col(weight) if weight else F.lit(1)
    by_score = df.groupBy(*groups, "score").agg(
        F.sum(F.when(F.col("label") == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 0, w).otherwise(0)).alias("neg"),
    )
    run = running_totals(by_score, ["score"], {"p": F.col("pos"), "n": F.col("neg")}, groups)
    below = F.col("n_upto") - F.col("neg")
    # Seen from the top score down: rows at or above this score.
    hits = F.col("p_all") - F.col("p_upto") + F.col("pos")
    alarms = F.col("n_all") - F.col("n_upto") + F.col("neg")
    wins = F.col("pos").cast("double") * (2 * below + F.col("neg"))
    precision = F.col("pos") * hits.cast("double") / (hits + alarms)
    out = run.groupBy(*groups).agg(
        F.sum(wins).alias("wins"),
        F.sum(precision).alias("precision_sum"),
        F.max("p_all").alias("positives"),
        F.max("n_all").alias("negatives"),
    )
    p, n = F.col("positives"), F.col("negatives")
    both = (p > 0) & (n > 0)
    return out.select(
        *groups,
        (p + n).alias("rows"),
        p.alias("positives"),
        (p / (p + n)).alias("prevalence"),
        F.when(both, F.col("wins") / (F.lit(2.0) * p * n)).alias("auroc"),
        F.when(both, F.col("precision_sum") / p).alias("pr_auc"),
    )


def brier(weight: str | None = None) -> Column:
    gap = F.col("score") - F.col("label")
    if weight is None:
        return F.avg(gap * gap)
    return F.sum(F.col(weight) * gap * gap) / F.sum(weight)


def calibration(
    df: DataFrame, row_id: str, bins: int = CALIBRATION_BINS, groups: list[str] | None = None, weight: str | None = None
) -> DataFrame:
    """Equal-count bins over the score rank: score range, mean score, observed rate, count.

    Ties are ordered by the row id. A weighted row stands for that many copies and may reach
    across a bin edge, so each row is dealt to the bins its positions fall in.
    """
    groups = list(groups or [])
    w = F.col(weight) if weight else F.lit(1)
    run = running_totals(df, ["score", row_id], {"k": w}, groups)
    first, last, total = F.col("k_upto") - w + 1, F.col("k_upto"), F.col("k_all")
    if weight is None:
        dealt = run.select("*", bin_of(last, total, bins).alias("bin"), F.lit(1).alias("_m"))
    else:
        spread = run.filter(w > 0).select(
            "*", F.explode(F.sequence(bin_of(first, total, bins), bin_of(last, total, bins))).alias("bin")
        )
        low, high = bin_end(F.col("bin") - 1, total, bins), bin_end(F.col("bin"), total, bins)
        dealt = spread.withColumn("_m", F.least(last, high) - F.greatest(first - 1, low))
    m = F.col("_m")
    return dealt.groupBy(*groups, "bin").agg(
        F.min("score").alias("lower"),
        F.max("score").alias("upper"),
        (F.sum(m * F.col("score")) / F.sum(m)).alias("mean_score"),
        (F.sum(m * F.col("label")) / F.sum(m)).alias("observed_rate"),
        F.sum(m).alias("count"),
    )


def calibration_error(table: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Count-weighted mean absolute gap of a calibration table."""
    gap = F.abs(F.col("mean_score") - F.col("observed_rate"))
    return table.groupBy(*(groups or [])).agg((F.sum(F.col("count") * gap) / F.sum("count")).alias("ece"))


# The quantiles of a score summary.
SUMMARY_QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def score_summary(df: DataFrame, score: str = "score") -> DataFrame:
    """Count, mean, range and five quantiles; count 0 and NULLs when there is nothing."""
    basics = df.agg(
        F.count(score).alias("count"), F.avg(score).alias("mean"), F.min(score).alias("minimum"),
        F.max(score).alias("maximum"),
    )
    quantiles = exact_quantiles(df, score, SUMMARY_QUANTILES)
    return basics.join(quantiles, "count", "left").select(
        "count", "mean", "minimum", *SUMMARY_QUANTILES, "maximum"
    )


def summarize_all(df: DataFrame, row_id: str, groups: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """AUROC, average precision, ECE and Brier score side by side, one row per group."""
    groups = list(groups or [])
    ranked = ranking(df, groups, weight)
    ece = calibration_error(calibration(df, row_id, groups=groups, weight=weight), groups)
    loss = df.groupBy(*groups).agg(brier(weight).alias("brier"))
    if groups:
        return ranked.join(ece, groups).join(loss, groups)
    one = lambda d: d.withColumn("_one", F.lit(1))
    return one(ranked).join(one(ece), "_one").join(one(loss), "_one").drop("_one")
