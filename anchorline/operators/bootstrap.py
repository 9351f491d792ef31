"""Entity-level bootstrap by weight vectors: resample entities with replacement, keep all their rows.

A replicate weighs every entity by how often it draws it. Most of an entity's draws come from a hash of its own id, one
Poisson count a replicate, so they need no shuffle; the few that are missing to as many draws as there are entities are
drawn one by one and joined. Together they are the multinomial counts of drawing with replacement. Rows carry their
entity, never their replicates: a task works on arrays of one number a replicate and returns sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anchorline.contracts import BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED, CALIBRATION_BINS
from anchorline.functions.hashing import uniform
from anchorline.operators.rank import RANGE, with_row_number
from anchorline.session import materialize

METRICS = ("auroc", "pr_auc", "ece", "brier")
# Uniform numbers of 32 bits that one digest gives.
WORDS = 8
# Rows worked on together: a matrix of so many rows and one column a replicate.
CHUNK = 1024


def poisson_level(entities: int) -> int:
    """j of the Poisson mean 1 - 2^-j: as near to 1 as leaves six deviations to the number of draws."""
    return max(0, math.floor(math.log2(max(1.0, math.sqrt(entities) / 6))))


def poisson_bounds(level: int) -> list[int]:
    """A 32-bit number reaches the count k of the level's Poisson law if it is at least bound k - 1 (k from 1)."""
    mean, bounds, term, total = 1 - 2.0**-level, [], 0.0, 0.0
    for k in range(64):
        term = math.exp(-mean) if k == 0 else term * mean / k
        total += term
        bound = math.floor(total * 2.0**32)
        if bound >= 2**32 or (k and term < 2.0**-40):
            break
        bounds.append(bound)
    return bounds


def own_counts(entity: str, replicates: int, seed: int, bounds: np.ndarray) -> np.ndarray:
    """The Poisson counts of one entity, one a replicate."""
    blocks = -(-replicates // WORDS)
    digests = b"".join(sha256(f"{seed}/{entity}/{b}".encode()).digest() for b in range(blocks))
    return np.searchsorted(bounds, np.frombuffer(digests, ">u4")[:replicates], "right").astype(np.int64)


@dataclass(frozen=True)
class Draws:
    """How entities are weighed: the Poisson bounds, the replicates that leave them out, and the joined draws.

    ``extra`` has one row for each entity that was drawn one by one: the entity and the replicates that did.
    """

    replicates: int
    seed: int
    bounds: np.ndarray
    without: np.ndarray
    extra: DataFrame

    def weights(self, entities: list[str], extra: list[list[int] | None]) -> np.ndarray:
        """A matrix: a row for each entity, a column for each replicate."""
        known: dict[str, np.ndarray] = {}
        out = np.empty((len(entities), self.replicates), np.int64)
        for n, (entity, more) in enumerate(zip(entities, extra, strict=True)):
            if entity not in known:
                counts = own_counts(entity, self.replicates, self.seed, self.bounds)
                counts[self.without] = 0
                if more:
                    np.add.at(counts, more, 1)
                known[entity] = counts
            out[n] = known[entity]
        return out


def draw(entities: DataFrame, replicates: int, seed: int) -> Draws:
    """Decide all draws of the distinct values of the first column; null is no entity."""
    column = entities.columns[0]
    named = entities.select(F.col(column).cast("string").alias("entity")).filter("entity IS NOT NULL").distinct()
    indexed = materialize(with_row_number(named, ["entity"], "_index"))
    n = indexed.count()
    bounds = np.array(poisson_bounds(poisson_level(n)), np.int64)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(replicates, np.int64)
        for batch in batches:
            for entity in batch.column(0).to_pylist():
                sums += own_counts(entity, replicates, seed, bounds)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(sums)], ["replicate", "drawn"])

    # One number a replicate comes to the driver.
    drawn = np.zeros(replicates, np.int64)
    for r in indexed.select("entity").mapInArrow(totals, "replicate INT, drawn BIGINT").groupBy("replicate").agg(F.sum("drawn").alias("drawn")).collect():
        drawn[r["replicate"]] = r["drawn"]
    # With more draws than there may be (rare) or none by hash, all are drawn one by one.
    without = drawn > n
    missing = np.where(without, n, n - drawn)
    slots = entities.sparkSession.createDataFrame([(r, int(m)) for r, m in enumerate(missing) if m], "replicate INT, missing BIGINT")
    picked = slots.repartition("replicate").select("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("missing") - 1)).alias("slot")).select(
        "replicate", (F.floor(uniform(seed, F.lit("extra"), F.col("replicate"), F.col("slot")) * n) + 1).alias("_index")
    )
    extra = picked.groupBy("_index").agg(F.array_sort(F.collect_list("replicate")).alias("extra")).join(indexed, "_index").select("entity", "extra")
    return Draws(replicates, seed, bounds, without, materialize(extra))


def entity_weights(entities: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Each distinct entity (first column, its own type) and ``weights``: how often each replicate draws it, in order.

    Weights depend on the ids and the seed only, and every replicate's add up to the number of entities.
    """
    column = entities.columns[0]
    drawn = draw(entities, replicates, seed)
    named = entities.select(column, F.col(column).cast("string").alias("entity")).distinct().filter(F.col(column).isNotNull())
    fixed = Draws(replicates, seed, drawn.bounds, drawn.without, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                found = fixed.weights(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                cells = pa.ListArray.from_arrays(np.arange(0, found.size + 1, replicates, dtype=np.int32), pa.array(found.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), cells], [column, "weights"])

    kind = dict(entities.dtypes)[column]
    return named.join(drawn.extra, "entity", "left").select(column, "entity", "extra").mapInArrow(run, f"`{column}` {kind}, weights ARRAY<INT>")


class _Range:
    """The rows of one key range in order, a chunk at a time: weights (the last column counts every row once), score, label."""

    def __init__(self, drawn: Draws, batches: Iterator[pa.RecordBatch]):
        self.drawn, self.batches, self.number = drawn, batches, None

    def __iter__(self):
        for whole in self.batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                self.number = batch.column(0)[0].as_py()
                found = self.drawn.weights(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                yield np.column_stack([found, np.ones(len(found), np.int64)]), batch.column(3).to_numpy(), batch.column(4).to_numpy()


class _Groups:
    """Rows of like score as sums of the weights of label 1 and of label 0; a group may go on in the next chunk."""

    def __init__(self):
        self.score, self.pos, self.neg = None, None, None

    def closed(self, weights: np.ndarray, scores: np.ndarray, labels: np.ndarray):
        """(scores, pos, neg) of the groups that end here; the last group stays open."""
        starts = np.flatnonzero(np.append(True, scores[1:] != scores[:-1]))
        pos = np.add.reduceat(weights * (labels == 1)[:, None], starts, axis=0)
        neg = np.add.reduceat(weights * (labels == 0)[:, None], starts, axis=0)
        found = scores[starts]
        if self.score is not None:
            if found[0] == self.score:
                pos[0] += self.pos
                neg[0] += self.neg
            else:
                found = np.append(self.score, found)
                pos, neg = np.vstack([self.pos[None], pos]), np.vstack([self.neg[None], neg])
        self.score, self.pos, self.neg = found[-1], pos[-1].copy(), neg[-1].copy()
        return found[:-1], pos[:-1], neg[:-1]


PARTS = "range INT, part INT, score DOUBLE, pos BINARY, neg BINARY"


def _sums(drawn: Draws):
    """First pass over a range: its first score, what lies between, and its last score, each as sums of weights.

    Only the first and the last score can go on in another range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, groups, out = _Range(drawn, batches), _Groups(), []
        between = [np.zeros(drawn.replicates + 1, np.int64) for _ in range(2)]
        for chunk in rows:
            scores, pos, neg = groups.closed(*chunk)
            if len(scores) and not out:
                out.append((0, float(scores[0]), pos[0], neg[0]))
                pos, neg = pos[1:], neg[1:]
            between[0] += pos.sum(axis=0)
            between[1] += neg.sum(axis=0)
        if groups.score is not None:
            if out:
                out.append((1, None, *between))
            out.append((2 if out else 0, float(groups.score), groups.pos, groups.neg))
        cells = [(rows.number, part, score, p.astype("<i8").tobytes(), n.astype("<i8").tobytes()) for part, score, p, n in out]
        columns = list(zip(*cells, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["range", "part", "score", "pos", "neg"])

    return run


def _ranked(pos: np.ndarray, neg: np.ndarray, pos_before: np.ndarray, neg_before: np.ndarray, whole: tuple) -> tuple[np.ndarray, np.ndarray]:
    """What groups of like score add to the pairs won (twice) and to the precision, by replicate.

    ``pos_before`` and ``neg_before`` are the weights at lower scores.
    """
    hits, alarms = whole[0] - pos_before, whole[1] - neg_before
    precision = np.where(pos > 0, pos * hits.astype(float) / np.maximum(hits + alarms, 1), 0.0)
    return pos.astype(float) * (2 * neg_before + neg), precision


def bin_ends(total: np.ndarray, bins: int) -> np.ndarray:
    """Positions at which equal-count bins end, a row for each bin: the first ``total % bins`` hold one more."""
    used = np.maximum(np.minimum(bins, total), 1)
    index = np.minimum(np.arange(1, bins + 1)[:, None], used)
    return index * (total // used) + np.minimum(index, total % used)


def _gaps(drawn: Draws, before: dict[int, tuple], whole: tuple, bins: int):
    """Second pass over a range: what its inner scores add to the rankings, and its rows to loss and calibration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, groups, width = _Range(drawn, batches), _Groups(), drawn.replicates + 1
        wins, precision, loss, gaps = np.zeros(width), np.zeros(width), np.zeros(width), np.zeros((bins, width))
        ends, first, held, at = bin_ends(whole[0] + whole[1], bins), True, None, None
        for weights, scores, labels in rows:
            if held is None:
                # Weights below the range, and the row position reached.
                held = [x.copy() for x in before[rows.number]]
                at = held[0] + held[1]
            _, pos, neg = groups.closed(weights, scores, labels)
            if len(pos):
                pos_before, neg_before = held[0] + np.cumsum(pos, axis=0) - pos, held[1] + np.cumsum(neg, axis=0) - neg
                won, precise = _ranked(pos, neg, pos_before, neg_before, whole)
                # The first score may have begun in an earlier range and is counted where its parts are joined.
                wins += won[int(first):].sum(axis=0)
                precision += precise[int(first):].sum(axis=0)
                held = [held[0] + pos.sum(axis=0), held[1] + neg.sum(axis=0)]
                first = False
            gap = scores - labels
            loss += (weights * (gap * gap)[:, None]).sum(axis=0)
            reached = at + np.cumsum(weights, axis=0)
            mass = np.cumsum(weights * gap[:, None], axis=0)
            for b in range(bins):
                if (ends[b] <= at).all():
                    continue
                if (ends[b] >= reached[-1]).all():
                    gaps[b] += mass[-1]
                    continue
                # Whole rows up to the bin's end, then the part of the row that crosses it.
                n = (reached <= ends[b]).sum(axis=0)
                some, column = n > 0, np.arange(width)
                last = np.maximum(n - 1, 0)
                gaps[b] += np.where(some, mass[last, column], 0.0)
                rest = np.where(n < len(scores), np.maximum(ends[b] - np.where(some, reached[last, column], at), 0), 0)
                gaps[b] += rest * gap[np.minimum(n, len(scores) - 1)]
            at = reached[-1]
        columns = [np.arange(width, dtype=np.int32), wins, precision, loss, *gaps]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["replicate", *_sum_names(bins)])

    return run


def _sum_names(bins: int) -> list[str]:
    return ["wins", "precision", "loss", *[f"gap_{b}" for b in range(bins)]]


def replicate_metrics(rows: DataFrame, *, entity: str, row_id: str, replicates: int, seed: int, bins: int = CALIBRATION_BINS) -> dict[str, np.ndarray]:
    """Every metric of every replicate, and last of the rows as they are; NaN where only one class is present.

    Rows with a null entity, score or label are left out. Takes two passes over the rows in order of (score, row_id).
    What comes to the driver is one array a key range and one number a replicate.
    """
    kept = rows.select(F.col(entity).cast("string").alias("entity"), F.col(row_id).alias("row"), F.col("score").cast("double"), F.col("label").cast("int")).dropna(
        subset=["entity", "score", "label"])
    drawn = draw(kept.select("entity"), replicates, seed)
    order = ["score", "row"]
    ordered = kept.join(drawn.extra, "entity", "left").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ordered.select(F.spark_partition_id().alias(RANGE), "entity", "extra", "score", "label"))
    fixed = Draws(replicates, seed, drawn.bounds, drawn.without, None)
    width = replicates + 1
    parts = sorted(ranged.mapInArrow(_sums(fixed), PARTS).collect(), key=lambda r: (r["range"], r["part"]))
    at = [np.zeros(width, np.int64) for _ in range(2)]
    before, borders = {}, []
    for r in parts:
        sums = [np.frombuffer(r[c], "<i8") for c in ("pos", "neg")]
        before.setdefault(r["range"], (at[0].copy(), at[1].copy()))
        if r["score"] is not None:
            if borders and borders[-1][0] == r["score"]:
                borders[-1][1] += sums[0]
                borders[-1][2] += sums[1]
            else:
                borders.append([r["score"], sums[0].copy(), sums[1].copy(), at[0].copy(), at[1].copy()])
        at = [at[0] + sums[0], at[1] + sums[1]]
    whole = tuple(at)
    totals = {name: np.zeros(width) for name in _sum_names(bins)}
    schema = "replicate INT, " + ", ".join(f"{n} DOUBLE" for n in totals)
    if parts:
        shared = _gaps(fixed, before, whole, bins)
        for r in ranged.mapInArrow(shared, schema).groupBy("replicate").agg(*[F.sum(n).alias(n) for n in totals]).collect():
            for name in totals:
                totals[name][r["replicate"]] = r[name]
    for _, pos, neg, *below in borders:
        won, precise = _ranked(pos, neg, *below, whole)
        totals["wins"] += won
        totals["precision"] += precise
    pos, neg = (x.astype(float) for x in whole)
    masses = np.vstack([np.zeros(width), *[totals[f"gap_{b}"] for b in range(bins)]])
    usable = (pos > 0) & (neg > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        found = {
            "auroc": totals["wins"] / (2 * pos * neg), "pr_auc": totals["precision"] / pos,
            "ece": np.abs(np.diff(masses, axis=0)).sum(axis=0) / (pos + neg), "brier": totals["loss"] / (pos + neg),
        }
    return {name: np.where(usable, values, np.nan) for name, values in found.items()}


def bootstrap_intervals(
    rows: DataFrame,
    *,
    entity: str,
    row_id: str,
    replicates: int = BOOTSTRAP_REPLICATES,
    seed: int = BOOTSTRAP_SEED,
    metrics: tuple[str, ...] = METRICS,
) -> DataFrame:
    """Point estimate and 2.5/97.5 percentile interval per metric.

    A replicate with a single label class is skipped; ``replicates_used`` counts the rest. Rows of a single class, and
    rows none of whose replicates can be used, raise ValueError.
    """
    found = replicate_metrics(rows, entity=entity, row_id=row_id, replicates=replicates, seed=seed)
    if np.isnan(found["auroc"][-1]):
        raise ValueError("rank metrics need both labels")
    used = ~np.isnan(found["auroc"][:-1])
    if not used.any():
        raise ValueError("no replicate holds both labels: there are too few entities of one of them")
    out = []
    for m in metrics:
        low, high = np.quantile(found[m][:-1][used], [0.025, 0.975])
        out.append((m, float(found[m][-1]), float(low), float(high), int(used.sum())))
    return rows.sparkSession.createDataFrame(out, "metric STRING, value DOUBLE, ci_low DOUBLE, ci_high DOUBLE, replicates_used BIGINT")
