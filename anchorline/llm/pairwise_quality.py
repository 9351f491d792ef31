"""Document quality by Bradley-Terry ranking.

The model never sees a label on its own, only which of two documents is preferred: the probability that one beats the
other is the logistic function of the difference of their scores, which are linear in a few measures of the text. The
cut between good and bad is then a quantile of the scores.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from anchorline.llm.labelled import held_out, training_labels
from anchorline.llm.store import stored
from anchorline.operators.rank import running_totals

SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~=+@]")
MEASURES = 12
CUT = 0.3


def measures(text: str) -> list[float]:
    """Rates between 0 and 1 that tell damaged text from prose; all zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * MEASURES
    chars = sum(map(len, words))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    lowered = text.lower()
    upper = sum(a != b for a, b in zip(text, lowered, strict=True)) if len(lowered) == len(text) else sum(map(str.isupper, text))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        min(1.0, len(SYMBOL.findall(text)) / n),
        min(1.0, text.count("!") / n),
        min(1.0, text.count("|") / n),
        upper / chars,
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - (pairs + 1) / n,
        1 - len(set(lines)) / len(lines),
        min(1.0, len(lines) / n),
        min(1.0, chars / n / 20),
        1 / n,
        min(1.0, sum(map(text.count, "0123456789")) / chars),
    ]


@dataclass(frozen=True)
class Ranking:
    """Score of a text: ``weights`` times its measures; ``cut`` and ``spread`` map scores to the unit interval."""

    weights: tuple[float, ...]
    cut: float
    spread: float
    quantile: float

    def raw(self) -> Column:
        return sum((F.col("measures")[i] * w for i, w in enumerate(self.weights)), F.lit(0.0))

    def scale(self) -> Column:
        """Increasing map to 0..1 that sends the cut to CUT."""
        steps = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), (self.raw() - F.lit(self.cut)) / F.lit(self.spread)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-steps) * F.lit((1 - CUT) / CUT))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every row's text, computed once for fitting and scoring."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                told = pa.array([measures(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), told], ["doc_id", "measures"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, measures ARRAY<DOUBLE>"), "measures")


def _slopes(block: pa.Table, weights: np.ndarray, scale: np.ndarray, rivals: int) -> pa.Table:
    """Sums over a block's pairs: the loss's gradient and curvature at the weights, and the number of pairs."""
    truth = block.column("label").to_numpy()
    seen = np.array(block.column("measures").to_pylist()) / scale
    # Rows come in any order; the draw follows the hash of the id.
    order = np.lexsort([*seen.T[::-1], block.column("place").to_numpy()])
    truth, seen = truth[order], seen[order]
    good, bad = np.flatnonzero(truth == 1), np.flatnonzero(truth == 0)
    sums = np.zeros(MEASURES + MEASURES * MEASURES + 1)
    if len(good) and len(bad):
        draw = np.random.default_rng(7)
        winners = np.concatenate([np.repeat(good, rivals), draw.choice(good, len(bad) * rivals)])
        losers = np.concatenate([draw.choice(bad, len(good) * rivals), np.repeat(bad, rivals)])
        differences = seen[winners] - seen[losers]
        lost = 1 / (1 + np.exp(np.clip(differences @ weights, -500, 500)))
        bend = differences.T @ (differences * (lost * (1 - lost))[:, None])
        sums = np.concatenate([-(differences * lost[:, None]).sum(axis=0), bend.ravel(), [len(winners)]])
    return pa.table({"place": np.arange(len(sums)), "part": sums})


def _step(weights: np.ndarray, scale: np.ndarray, rivals: int) -> Callable[[pa.Table], pa.Table]:
    return lambda block: _slopes(block, weights, scale, rivals)


def fit(seen: DataFrame, labels: DataFrame, rivals: int = 16, rounds: int = 20, decay: float = 1e-3, minority: int = 64) -> Ranking:
    """Learn from pairs of a document labelled 1 and one labelled 0, of every labelled row of ``seen`` (see ``measured``).

    Rows are dealt by the hash of their id into blocks with some ``minority`` rows of the rarer label each. In its block,
    each is compared with ``rivals`` of the other label, drawn with a fixed seed. The driver gets the sums of a Newton step,
    never a row. The cut is the score that parts the two labels best, by the counts at every score. Without both labels
    every document scores alike, above the cut.
    """
    known = stored(seen.join(training_labels(labels, "quality"), "doc_id").withColumn("place", F.xxhash64("doc_id")), "labelled")
    told = known.agg(
        F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"),
        *[F.stddev_pop(F.col("measures")[i]).alias(f"s{i}") for i in range(MEASURES)],
    ).first()
    if not told["good"] or not told["bad"]:
        return Ranking((0.0,) * MEASURES, -1.0, 1.0, 0.0)
    scale = np.array([told[f"s{i}"] for i in range(MEASURES)]) + 1e-6
    blocks = max(1, min(told["good"], told["bad"]) // minority)
    dealt = known.withColumn("block", F.pmod("place", F.lit(blocks))).groupBy("block")
    weights = np.zeros(MEASURES)
    for _ in range(rounds):
        sums = dealt.applyInArrow(_step(weights, scale, rivals), "place BIGINT, part DOUBLE").groupBy("place").agg(F.sum("part").alias("part")).collect()
        flat = np.array([r["part"] for r in sorted(sums, key=lambda r: r["place"])])
        if not flat[-1]:
            break
        slope = flat[:MEASURES] / flat[-1] + decay * weights
        bend = flat[MEASURES:-1].reshape(MEASURES, MEASURES) / flat[-1] + decay * np.eye(MEASURES)
        change = np.linalg.solve(bend, slope)
        # A step where the pairs are nearly parted may overshoot.
        change *= min(1.0, 3 / (np.linalg.norm(change) + 1e-12))
        weights = weights - change
        if np.abs(change).max() < 1e-4:
            break
    weights = tuple(float(w) for w in weights / scale)
    plain = known.select("label", Ranking(weights, 0.0, 1.0, 0.0).raw().alias("raw"))
    spread = plain.filter("label = 1").agg(F.stddev_pop("raw")).first()[0] + 1e-6
    counts = plain.groupBy("raw").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    run = running_totals(counts, ["raw"], {"lost": F.col("good"), "caught": F.col("bad")})
    gain = F.col("caught_upto") / F.col("caught_all") - F.col("lost_upto") / F.col("lost_all")
    best = run.select("raw", gain.alias("gain"), (F.col("caught_upto") + F.col("lost_upto")).alias("upto")).orderBy(F.desc("gain"), "raw").first()
    above = counts.filter(F.col("raw") > F.lit(best["raw"])).agg(F.min("raw")).first()[0]
    cut = (best["raw"] + (best["raw"] if above is None else above)) / 2
    return Ranking(weights, float(cut), float(spread), best["upto"] / (told["good"] + told["bad"]))


def score(docs: DataFrame, labels: DataFrame, ranking: Ranking | None = None) -> DataFrame:
    """Fit (unless given a ranking) and score all: doc_id, held_out, score, predicted.

    Needs doc_id and text, ignores other columns, keeps repeated rows; a null text counts as empty and is ranked by
    its zero measures.
    """
    seen = measured(docs)
    ranking = ranking or fit(seen, labels)
    return seen.select("doc_id", ranking.scale().alias("score")).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
