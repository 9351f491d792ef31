"""Near-duplicate documents: a Jaccard join on word shingles with Bayesian pruning.

Documents with the same set of shingles form one class and are looked at once. Classes that share a band of MinHash
values are compared value by value: as soon as the posterior probability that the similarity reaches the threshold
falls under a tolerance, the pair is dropped. What survives only joins classes into provisional groups; within a group
the same pruning runs again, and surviving pairs are verified exactly on their shingles. Large buckets and groups are
cut into chunks that meet pairwise in blocks of bounded size, and a block reports counts and a spanning forest, never
its pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.components import components
from anchorline.llm.phrase_index import small_side
from anchorline.llm.store import stored

WORD = re.compile(r"\w+")
SHINGLE = 5
BANDS, ROWS = 25, 5
VALUES = BANDS * ROWS
STEP = 25
CHUNK = 384
REMEMBERED = 300_000


class _WordHash(dict):
    """64-bit hash of each word, alike in all processes."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


_HASHES = _WordHash()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the runs of SHINGLE lower-case words; a shorter text with a word is one shingle."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    runs = np.full(len(words) - size + 1, size, np.uint64)
    for n in range(size):
        runs = _mixed(runs + codes[n : len(codes) - size + 1 + n])
    return np.unique(runs)


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(2024)
    return draw.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, VALUES, np.uint64)


def min_hashes(found: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 32 bits."""
    times, plus = _permutations()
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096, None] * times + plus
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


@lru_cache(8)
def needed(threshold: float, tolerance: float) -> tuple[int, ...]:
    """How many of the first STEP, 2 * STEP, ... values must agree for a pair to be looked at further.

    With a uniform prior, m agreeing values of n leave a Beta(m + 1, n - m + 1) posterior; the chance that it reaches
    the threshold is that of at most m successes in n + 1 draws of that probability.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        chance, m = 0.0, 0
        while True:
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def surviving(values: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which of the pairs the incremental comparison keeps, as positions."""
    alive, agree = np.arange(len(left)), np.zeros(len(left), np.int32)
    for n, least in enumerate(needed(threshold, tolerance)):
        part = slice(n * STEP, (n + 1) * STEP)
        agree = agree + (values[left[alive], part] == values[right[alive], part]).sum(axis=1, dtype=np.int32)
        keep = agree >= least
        alive, agree = alive[keep], agree[keep]
    return alive


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, print (of the shingle set; null without words), bands, values (16 bits of each MinHash value)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                prints, bands, values = [], [], []
                for text in batch.column(1):
                    found = shingles(text.as_py())
                    if not len(found):
                        prints.append(None), bands.append(None), values.append(None)
                        continue
                    least = min_hashes(found)
                    prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    key = np.arange(BANDS, dtype=np.uint64)
                    for n in range(ROWS):
                        key = _mixed(key + least.reshape(BANDS, ROWS)[:, n])
                    bands.append(key.astype(np.int64))
                    values.append(least.astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(values, pa.binary())],
                    ["doc_id", "print", "bands", "values"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, print BINARY, bands ARRAY<BIGINT>, values BINARY")


def _by_block(rows: DataFrame, work: Callable[[dict], tuple], schema: str, names: list[str]) -> DataFrame:
    """Run ``work`` on whole blocks. ``rows`` has columns block (string) and side; a block fits a task easily.

    Blocks are brought together by sorting, and a task hands over as many whole blocks as a batch of rows holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            blocks = table.column("block").to_pylist()
            end = len(blocks)
            while end and blocks[end - 1] == blocks[-1]:
                end -= 1
            rest = table.slice(end)
            if end:
                yield pa.RecordBatch.from_arrays([*work(table.slice(0, end))], names)
        if rest is not None and rest.num_rows:
            yield pa.RecordBatch.from_arrays([*work(rest)], names)

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def _pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a table of whole blocks that the block is to compare, and the number of each row's block.

    A block of one chunk compares all its rows, a block of two the rows of different chunks.
    """
    blocks = table.column("block").to_pylist()
    number = np.cumsum([0, *(a != b for a, b in zip(blocks, blocks[1:], strict=False))])
    side = np.array(table.column("side").to_pylist(), np.int32)
    single = np.array(table.column("single").to_pylist(), bool)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, len(blocks)):
        here = np.flatnonzero(number[:-d] == number[d:])
        if not len(here):
            break
        here = here[single[here] | (side[here] != side[here + d])]
        left.append(here), right.append(here + d)
    return np.concatenate(left), np.concatenate(right), number


def _roots(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row, the least id joined to it by the pairs."""
    parent = list(range(len(ids)))

    def find(n: int) -> int:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            if ids[b] < ids[a]:
                a, b = b, a
            parent[b] = a
    return ids[[find(n) for n in range(len(ids))]]


def _blocked(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Deal the rows of each key into blocks: one if they are few, else one for each pair of chunks."""
    chunks = F.ceil(F.col(size) / CHUNK).cast("int")
    side = F.pmod(F.xxhash64("id"), chunks).cast("int")
    return (
        rows.withColumn("chunks", chunks).withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("single", F.col("side") == F.col("other"))
        .withColumn("block", F.concat_ws("/", F.col(key), F.least("side", "other"), F.greatest("side", "other")))
        .drop("chunks", "other")
    )


def _provisional(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (a, b) that hold together all classes with a surviving pair between them."""
    banded = stored(classes.select("id", F.explode("bands").alias("band")), "jaccard-bands")
    crowded = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    members = banded.join(crowded, "band").join(classes.select("id", "values"), "id")

    def work(table: pa.Table) -> tuple:
        ids = table.column("id").to_numpy()
        values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint16).reshape(-1, VALUES)
        left, right, _ = _pairs(table)
        kept = [surviving(values, left[n : n + 200_000], right[n : n + 200_000], threshold, tolerance) + n for n in range(0, len(left), 200_000)]
        kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        # Equal ids of other blocks of this batch stay apart: roots are found by row.
        roots = _roots(ids, left[kept], right[kept])
        moved = roots != ids
        return pa.array(ids[moved]), pa.array(roots[moved])

    blocks = _blocked(members, "band", "size").select("block", "side", "single", "id", "values")
    return _by_block(blocks, work, "a BIGINT, b BIGINT", ["a", "b"]).distinct()


def _verified(docs: DataFrame, groups: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Exact links inside provisional groups: id, root (least id joined to it in a block), links (documents)."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [shingles(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n) for n in ("id", "group", "size", "weight")]
                    + [pa.array([f.tobytes() for f in found], pa.binary()),
                       pa.array([min_hashes(f).astype(np.uint16).tobytes() for f in found], pa.binary())],
                    ["id", "group", "size", "weight", "found", "values"],
                )

    def work(table: pa.Table) -> tuple:
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint16).reshape(-1, VALUES)
        found = [np.frombuffer(f, np.uint64) for f in table.column("found").to_pylist()]
        left, right, number = _pairs(table)
        kept = [surviving(values, left[n : n + 200_000], right[n : n + 200_000], threshold, tolerance) + n for n in range(0, len(left), 200_000)]
        kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        left, right = left[kept], right[kept]
        order = np.argsort(number[left], kind="stable")
        left, right = left[order], right[order]
        linked = np.zeros(len(left), bool)
        starts = np.flatnonzero(np.r_[True, number[left][1:] != number[left][:-1]]) if len(left) else []
        for at, end in zip(starts, [*starts[1:], len(left)], strict=True):
            linked[at:end] = similar(found, left[at:end], right[at:end], threshold)
        left, right = left[linked], right[linked]
        links = np.bincount(left, weight[right], len(ids)) + np.bincount(right, weight[left], len(ids))
        return pa.array(ids), pa.array(_roots(ids, left, right)), pa.array(links.astype(np.int64))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(small_side(groups), "id")
    prepared = texts.select("id", "group", "size", "weight", "text").mapInArrow(
        prepare, "id BIGINT, group BIGINT, size BIGINT, weight BIGINT, found BINARY, values BINARY"
    )
    blocks = _blocked(prepared, "group", "size").select("block", "side", "single", "id", "weight", "found", "values")
    return _by_block(blocks, work, "id BIGINT, root BIGINT, links BIGINT", ["id", "root", "links"])


def similar(found: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Exact test of pairs of shingle sets: common / all >= threshold."""
    used = np.unique(np.concatenate([left, right]))
    sizes = np.array([len(f) for f in found], np.int64)
    if len(left) > 4 * len(used):
        # Many pairs among few sets: count all common shingles by products of 0/1 matrices, some columns at a time.
        row_of = np.repeat(np.arange(len(used)), sizes[used])
        names, column_of = np.unique(np.concatenate([found[n] for n in used]), return_inverse=True)
        order = np.argsort(column_of, kind="stable")
        row_of, column_of = row_of[order], column_of[order]
        common = np.zeros((len(used), len(used)), np.float64)
        for at in range(0, len(names), 4096):
            low, high = np.searchsorted(column_of, [at, at + 4096])
            part = np.zeros((len(used), min(4096, len(names) - at)), np.float32)
            part[row_of[low:high], column_of[low:high] - at] = 1
            common += part @ part.T
        place = np.searchsorted(used, left), np.searchsorted(used, right)
        both = common[place].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(found[a], found[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], np.int64)
    return both >= threshold * (sizes[left] + sizes[right] - both) - 1e-9


def near_duplicates(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-4) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, text_class, n_links.

    ``text_class`` is the least doc_id with the same set of shingles, ``class_id`` the least doc_id that chains of
    links reach, ``n_links`` the number of other documents at or above the threshold. Words are lower-case runs of
    letters, digits and underscores. Documents without words have no links and are their own class. doc_id is an
    integer; rows with a null id are returned with null classes and no links, rows that share an id count as one
    document. Other columns are ignored; no rows give no rows. A pair at the threshold is missed with a probability
    under 1e-4 by the bands and under about the tolerance by the pruning.
    """
    kind = dict(docs.dtypes)["doc_id"]
    seen = stored(sketches(docs), "jaccard-sketches")
    whole = seen.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(
        whole.groupBy("print").agg(
            F.min(F.struct(F.col("doc_id").cast("bigint").alias("id"), "bands", "values")).alias("f"),
            F.count(F.lit(1)).alias("weight"),
        ).select("print", "f.id", "f.bands", "f.values", "weight"),
        "jaccard-classes",
    )
    held = components(_provisional(classes, threshold, tolerance))
    sized = held.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    weights = classes.groupBy("id").agg(F.sum("weight").alias("weight"))
    groups = stored(
        held.join(sized, "root").join(weights, F.col("node") == F.col("id"))
        .select("id", F.col("root").alias("group"), "size", "weight"),
        "jaccard-groups",
    )
    met = stored(_verified(docs, groups, threshold, tolerance), "jaccard-links")
    final = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    told = (
        classes.select("print", "id", "weight").join(links, "id", "left")
        .join(final.withColumnRenamed("node", "id"), "id", "left")
        .select("print", F.col("id").alias("text_class"), F.coalesce("root", "id").alias("class_id"),
                (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    return seen.select("doc_id", "print").join(told, "print", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").cast(kind).alias("class_id"),
        F.coalesce("text_class", "doc_id").cast(kind).alias("text_class"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
