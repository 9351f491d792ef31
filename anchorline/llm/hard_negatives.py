"""Hard negatives by angular triangle filtering.

Angles obey the triangle inequality. With the angles of two vectors to a reference direction stored, their own angle
lies between the difference and the sum of the two, so the cosine lies in an interval, and norms turn that into bounds
of the inner product. Bounds are widened for rounding. Only rows whose bounds overlap a window that is still open are
scored, exactly, in integers. Whole blocks of rows are passed over by the ranges of their angles in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.llm.store import stored

# Reference directions; rows of one block; rows from which the directions are chosen.
DIRECTIONS = 24
BLOCK = 1024
SAMPLE = 2_000
# Bytes of anchors that travel to the tasks at once; the rows are read once for every so many.
CHUNK_BYTES = 16 << 20
# Integer sums up to this size are exact in doubles.
EXACT = float(1 << 53)
# The largest error of a stored cosine, with room to spare, as a share of the product of the norms.
SLACK = 1e-6
LONG = (-(1 << 63), (1 << 63) - 1)


def taking_part(rows: DataFrame, label: Column, scale: int) -> DataFrame:
    """id, label, q (integers floor(scale * x) as doubles) of the rows that can be compared; one row for each id.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component are left out. Of several
    rows of one id the least (label, vector) stays.
    """
    sound = F.expr("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    return (
        rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(F.coalesce(sound, F.lit(False)))
        .select("id", "label", F.transform("v", lambda x: F.rint(F.expr("0D") + _floor(x * scale))).alias("q"))
        .groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")
    )


def _floor(x: Column) -> Column:
    """floor as a double, whatever the size: from 2^52 on doubles have no fraction."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def directions(rows: DataFrame, count: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors to which angles are stored: rows far from one another, out of a sample drawn by the hash of the id.

    At most SAMPLE rows are looked at, so the driver's share does not grow. Any directions would give right results.
    """
    found = rows.select("id", "q").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    width = max([len(r["q"]) for r in found], default=1)
    vectors = np.zeros((len(found), width))
    for n, r in enumerate(found):
        vectors[n, : len(r["q"])] = r["q"]
    vectors = vectors[np.abs(vectors).max(axis=1, initial=0) > 0]
    if not len(vectors):
        return np.ones((1, width)) / np.sqrt(width)
    unit = _scaled(vectors)[0]
    chosen, nearest = [0], np.abs(unit @ unit[0])
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, np.abs(unit @ unit[chosen[-1]]))
    return unit[chosen]


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms, without overflow; a zero vector keeps its zeros."""
    top = np.abs(vectors).max(axis=1, initial=0)
    top[top == 0] = 1
    small = vectors / top[:, None]
    norms = np.sqrt((small * small).sum(axis=1))
    norms[norms == 0] = 1
    return small / norms[:, None], np.where(np.abs(vectors).max(axis=1, initial=0) > 0, norms * top, 0.0)


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and width is None and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), max(sizes.max(initial=1), width or 1)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _fitted(vectors: np.ndarray, width: int) -> np.ndarray:
    return vectors[:, :width] if vectors.shape[1] >= width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


BLOCKS = "block STRING, label BIGINT, ids ARRAY<BIGINT>, q BINARY, angles BINARY, norms BINARY"


def blocks(rows: DataFrame, refs: np.ndarray, size: int = BLOCK) -> DataFrame:
    """Rows of one label and of like angles in blocks: ids, vectors, norms and angles as packed columns, written down.

    Rows are range-partitioned by (label, nearest direction, angle to it, id), so a label or a vector that holds a third
    of all rows spreads over partitions, and a block never crosses a label.
    """
    shared = rows.sparkSession.sparkContext.broadcast(refs)

    def angles(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit, norms = _scaled(vectors)
        width = max(unit.shape[1], shared.value.shape[1])
        return np.arccos(np.clip(_fitted(unit, width) @ _fitted(shared.value, width).T, -1, 1)), norms

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                told = angles(_matrix(batch.column(2)))[0]
                near = told.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near, pa.int32()), pa.array(told[np.arange(len(near)), near])], ["id", "label", "q", "near", "angle"]
                )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(part: pa.Table) -> pa.RecordBatch:
            ids, label = part.column(0).to_numpy(), part.column(1)[0].as_py()
            vectors = _matrix(part.column(2).combine_chunks())
            values = [f"{label}:{ids[0]}", label, ids, *(x.astype("<f8").tobytes() for x in (vectors, *angles(vectors)))]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                              ["block", "label", "ids", "q", "angles", "norms"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            labels = held.column(1).to_numpy()
            while len(labels):
                stop = min(size, int(np.searchsorted(labels, labels[0], "right")))
                if stop == len(labels) and stop < size:
                    break
                yield packed(held.slice(0, stop))
                held, labels = held.slice(stop), labels[stop:]
        if held is not None and held.num_rows:
            yield packed(held)

    placed = stored(rows.select("id", "label", "q").mapInArrow(place, "id BIGINT, label BIGINT, q ARRAY<DOUBLE>, near INT, angle DOUBLE"), "negatives-rows")
    order = ("label", "near", "angle", "id")
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "label", "q")
    return stored(dealt.mapInArrow(deal, BLOCKS), "negatives-blocks")


class _Block:
    """A packed block, opened."""

    def __init__(self, label: int, ids: list[int] | np.ndarray, q: bytes, angles: bytes, norms: bytes):
        self.label, self.ids = label, np.asarray(ids, np.int64)
        self.q, self.angles = (np.frombuffer(x, "<f8").reshape(len(self.ids), -1) for x in (q, angles))
        self.norms = np.frombuffer(norms, "<f8")
        self.top = float(np.abs(self.q).max(initial=0))


def _bounds(mine: np.ndarray, norm: float | np.ndarray, least: np.ndarray, most: np.ndarray, norms: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of inner products of one vector with rows whose angles lie from ``least`` to ``most`` and norms likewise."""
    apart = np.maximum(np.maximum(least - mine, mine - most), 0).max(axis=-1)
    sums = most + mine
    # Seen from the opposite direction the sum of the angles is as far from a full turn.
    around = np.where(least + mine >= np.pi, 2 * np.pi - (least + mine), np.pi)
    together = np.minimum(np.where(sums <= np.pi, sums, around), np.pi).min(axis=-1)
    high, low = np.cos(apart) + SLACK, np.cos(together) - SLACK
    small, large = norm * norms[0], norm * norms[1]
    lower, upper = np.where(low >= 0, low * small, low * large) - 1, np.where(high >= 0, high * large, high * small) + 1
    return np.minimum(lower, float(LONG[1])), np.maximum(upper, float(LONG[0]))


def _scores(a: _Block, i: int, b: _Block, rows: np.ndarray) -> np.ndarray:
    """Exact inner products with some rows of a block; missing components count as zero."""
    width = min(a.q.shape[1], b.q.shape[1])
    if a.top * b.top * width < EXACT:
        return (b.q[rows, :width] @ a.q[i, :width]).astype(np.int64)
    mine = [int(x) for x in a.q[i, :width]]
    sums = [sum(x * int(y) for x, y in zip(mine, row, strict=True)) for row in b.q[rows, :width]]
    return np.array([min(max(s, LONG[0]), LONG[1]) for s in sums], np.int64)


class _Best:
    """The best few (score, id) of one search, higher scores and then smaller ids first."""

    __slots__ = ("keep", "scores", "ids")

    def __init__(self, keep: int):
        self.keep, self.scores, self.ids = keep, np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.keep else -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.keep:
            good = scores >= self.scores[-1]
            scores, ids = scores[good], ids[good]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            first = np.lexsort((ids, ~scores))[: self.keep]
            self.scores, self.ids = scores[first], ids[first]


class _Asking:
    """A block of anchors: the windows each still has open and the best rows of each window so far."""

    def __init__(self, block: _Block, found: list | None, keep: int, percent: int):
        self.block = block
        if found is None:
            self.told, self.lows, self.highs = None, np.full((len(block.ids), 1), -np.inf), np.full((len(block.ids), 1), np.inf)
        else:
            # Open from so many percent of a positive's score up to the score; never below zero.
            self.told = [[(p["id"], -(-percent * p["score"] // 100), p["score"]) for p in cell or [] if p["score"] >= 0] for cell in found]
            slots = max(map(len, self.told), default=0)
            self.lows, self.highs = np.full((len(block.ids), slots), np.inf), np.full((len(block.ids), slots), -np.inf)
            for n, cell in enumerate(self.told):
                for k, (_, *ends) in enumerate(cell):
                    self.lows[n, k], self.highs[n, k] = ends
        self.keep = keep
        self.best: dict[tuple[int, int], _Best] = {}

    def look(self, b: _Block) -> None:
        """Score the rows of a block whose bounds overlap a window of an anchor."""
        a = self.block
        least, most = _bounds(a.angles, a.norms, b.angles.min(axis=0), b.angles.max(axis=0), (b.norms.min(), b.norms.max()))
        for i in np.flatnonzero(((most[:, None] >= self.lows) & (least[:, None] <= self.highs)).any(axis=1)).tolist():
            below, above = _bounds(a.angles[i], a.norms[i], b.angles, b.angles, (b.norms, b.norms))
            overlap = ((above[:, None] >= self.lows[i]) & (below[:, None] <= self.highs[i])).any(axis=1)
            rows = np.flatnonzero(overlap & (b.ids != a.ids[i]))
            if not len(rows):
                continue
            scores, ids = _scores(a, i, b, rows), b.ids[rows]
            for k in range(self.lows.shape[1] if self.told is None else len(self.told[i])):
                top = self.best.setdefault((i, k), _Best(self.keep))
                if self.told is None:
                    top.offer(scores, ids)
                else:
                    inside = (scores >= self.told[i][k][1]) & (scores <= self.told[i][k][2])
                    top.offer(scores[inside], ids[inside])
                # A full list narrows its window; this decides only what is scored, and bounds are wider than rounding.
                self.lows[i, k] = max(self.lows[i, k], top.floor())

    def rows(self) -> list[tuple]:
        out = []
        for (i, k), top in self.best.items():
            positive, _, score = self.told[i][k] if self.told is not None else (None, None, None)
            out += [(int(self.block.ids[i]), positive, score, s, n) for s, n in zip(top.scores.tolist(), top.ids.tolist(), strict=True)]
        return out


FOUND = "anchor BIGINT, positive BIGINT, positive_score BIGINT, score BIGINT, other BIGINT"


def _searched(anchors: DataFrame, rows: DataFrame, keep: int, percent: int, name: str) -> DataFrame:
    """Blocks of anchors against all blocks of rows: of their own label, or of others where ``positives`` are known.

    Anchors travel to the tasks a bounded chunk at a time, and each chunk reads all rows once; a task returns at most
    ``keep`` rows for each window.
    """
    spark, known = rows.sparkSession, "positives" in anchors.columns
    size = anchors.agg(F.sum(F.octet_length("q") + F.octet_length("angles") + F.octet_length("norms"))).first()[0] or 0
    chunks = 1 + size // CHUNK_BYTES
    found = []
    for n in range(chunks):
        part = anchors.filter(F.pmod(F.xxhash64("block"), F.lit(chunks)) == n).collect()
        shared = spark.sparkContext.broadcast([
            (r["label"], r["ids"], bytes(r["q"]), bytes(r["angles"]), bytes(r["norms"]),
             [[{"id": p["id"], "score": p["score"]} for p in cell or []] for cell in r["positives"]] if known else None) for r in part
        ])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asking = [_Asking(_Block(*r[:5]), r[5], keep, percent) for r in shared.value]
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, *packed = (batch.column(c)[i] for c in range(1, 5))
                    b = _Block(batch.column(0)[i].as_py(), ids.values.to_numpy(), *(x.as_py() for x in packed))
                    for a in asking:
                        if (a.block.label != b.label) == known:
                            a.look(b)
            cells = [row for a in asking for row in a.rows()]
            columns = list(zip(*cells, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "positive", "positive_score", "score", "other"])

        dealt = rows.select("label", "ids", "q", "angles", "norms").repartition(F.xxhash64("ids"))
        found.append(stored(dealt.mapInArrow(run, FOUND), name))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _first(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The first few of each search, with their rank; each task has kept no more than so many."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine(rows: DataFrame, anchor: Column, label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 5,
         percent: int = 80, count: int = DIRECTIONS, size: int = BLOCK) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Needs vec_id (integer), embedding (numbers) and label; ``anchor`` is a condition on ``id`` that says which rows are
    anchors and ``label`` may replace the label column. A score is the inner product of the vectors after
    floor(scale * x), in integers; vectors of unlike length are compared on the components they share, and scores beyond
    a long are held at its limits. Higher scores come first, ties by smaller id. For each anchor the first
    ``positives`` other rows of its label are its positives, and for each of them the first ``negatives`` rows of other
    labels that score at least ``percent`` of the positive's score and at most the score. A negative positive_score
    leaves no such row. Rows that cannot be compared take no part (see ``taking_part``); extra columns are ignored; an
    empty table gives an empty result.
    """
    part = stored(taking_part(rows, F.col("label") if label is None else label, scale), "negatives-parts")
    refs = directions(part, count)
    all_rows = blocks(part, refs, size)
    asking = blocks(part.filter(anchor), refs, size)
    found = _searched(asking, all_rows, positives, percent, "negatives-positives")
    best = _first(found, ["anchor"], positives).groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", F.col("other").alias("id")))).alias("positives")
    )
    # Back into the blocks, each anchor in its place.
    listed = asking.select("block", F.posexplode("ids").alias("at", "anchor")).join(best, "anchor", "left").groupBy("block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "positives"))), lambda x: x["positives"]).alias("positives")
    )
    told = stored(asking.join(listed, "block"), "negatives-anchors")
    pairs = _searched(told, all_rows, negatives, percent, "negatives-found")
    return _first(pairs, ["anchor", "positive"], negatives).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )

