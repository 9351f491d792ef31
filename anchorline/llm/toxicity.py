"""Toxicity by multiple-instance learning.

Only documents carry labels. A document is toxic if any of its sentences is, so sentence probabilities are combined by
noisy-or, P = 1 - prod(1 - p), and the sentence model is fitted through that formula. What the model then says about
single sentences locates the offending ones.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.labelled import held_out, training_sample

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5)
# Words a task remembers; beyond that it starts afresh, which costs time and changes nothing.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Model:
    """Log-odds of a sentence: the bias and a weight for each known part of its words."""

    bias: float
    weights: dict[str, float]


def parts(word: str) -> list[str]:
    """What a word is known by: itself and its beginnings, which inflected and made-up forms share."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


class _Weights(dict):
    """Total weight of each word met so far."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        total = self[word] = sum(self.weights.get(p, 0.0) for p in parts(word))
        return total


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and lower-case words of each sentence with a word."""
    for found in SENTENCE.finditer(text):
        words = WORD.findall(found.group().lower())
        if words:
            yield found.start(), found.end(), words


def fit(docs: DataFrame, labels: DataFrame, limit: int = 6000, longest: int = 50_000, rounds: int = 200,
        seen_in: int = 4, lift: float = 2.0, decay: float = 2e-6) -> Model:
    """Fit on at most ``limit`` labelled documents of at most ``longest`` characters.

    Full-batch gradient steps (Adam) on the cross-entropy of the noisy-or, over the words and beginnings that occur in
    ``seen_in`` documents of the sample and at least ``lift`` times as often in toxic ones as documents are toxic. Without both labels in the sample, every document scores 0 or 1 as the only label says.
    """
    sample = training_sample(docs, labels, "toxic", limit, longest).select("doc_id", "text", "label")
    rows = sorted((r["doc_id"], r["label"], r["text"]) for r in sample.toLocalIterator())
    truth = np.array([r[1] for r in rows], float)
    if not len(truth) or truth.min() == truth.max():
        return Model(30.0 if len(truth) and truth[0] else -30.0, {})
    frequency, toxic = Counter(), Counter()
    for _, label, text in rows:
        found = {p for w in set(WORD.findall(text.lower())) for p in parts(w)}
        frequency.update(found)
        if label:
            toxic.update(found)
    usual = min(0.5, lift * truth.mean())
    telling = sorted(p for p, c in frequency.items() if c >= seen_in and toxic[p] >= usual * c)
    del frequency, toxic
    index = {p: n for n, p in enumerate(telling)}
    doc_of, sentence_of, word_of, n = array("i"), array("i"), array("i"), 0
    for d, (_, _, text) in enumerate(rows):
        for _, _, words in sentences(text):
            doc_of.append(d)
            known = [index[p] for p in {p for w in set(words) for p in parts(w)} if p in index]
            word_of.extend(known)
            sentence_of.extend([n] * len(known))
            n += 1
    doc_of, sentence_of, word_of = (np.array(x, np.int32) for x in (doc_of, sentence_of, word_of))
    weights, bias = np.zeros(len(index)), -5.0
    size = len(index) + 1
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1):
        odds = np.bincount(sentence_of, weights[word_of], n) + bias
        chance = 1 / (1 + np.exp(-odds))
        calm = np.bincount(doc_of, np.logaddexp(0, odds), len(rows))
        pull = np.where(truth == 1, -1 / np.expm1(np.maximum(calm, 1e-9)), 1.0)
        slope = chance * pull[doc_of] / len(rows)
        change = np.append(np.bincount(word_of, slope[sentence_of], len(index)) + decay * weights, slope.sum())
        first += 0.1 * (change - first)
        second += 0.01 * (change * change - second)
        move = 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights -= move[:-1]
        bias -= move[-1]
    return Model(float(bias), {w: round(float(weights[i]), 6) for w, i in index.items() if abs(weights[i]) > 1e-3})


def score_text(text: str, weights: _Weights, bias: float, report: float) -> tuple[float, list[dict]]:
    """The document's probability, and the sentences whose own probability reaches ``report``."""
    spans, odds = [], []
    for start, end, words in sentences(text):
        odds.append(bias + sum(map(weights.__getitem__, set(words))))
        spans.append((start, end))
    if not odds:
        return 0.0, []
    odds = np.array(odds)
    score = float(-np.expm1(-np.logaddexp(0, odds).sum()))
    chance = 1 / (1 + np.exp(-odds))
    return score, [
        {"start": spans[n][0], "end": spans[n][1], "score": float(chance[n])} for n in np.flatnonzero(chance >= report).tolist()
    ]


def score(docs: DataFrame, model: Model, report: float = 0.5) -> DataFrame:
    """Per row: doc_id, score, offending (start, end, score of each sentence at or above ``report``).

    Offsets count characters of the text. Needs doc_id and text, ignores other columns, keeps repeated rows; a null,
    empty or wordless text scores 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = _Weights(shared.value.weights), shared.value.bias
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                told = [score_text(t.as_py() or "", weights, bias, report) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([s for s, _ in told], pa.float64()), pa.array([o for _, o in told], span)],
                    ["doc_id", "score", "offending"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score DOUBLE, offending ARRAY<STRUCT<start: INT, end: INT, score: DOUBLE>>"
    )


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents and score all: doc_id, held_out, score, predicted, offending."""
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending"
    )


def reject(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``, with all their columns and unchanged texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = _Weights(shared.value.weights), shared.value.bias
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                stays = [score_text(t.as_py() or "", weights, bias, 2.0)[0] < limit for t in batch.column(column)]
                yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
