"""Packing by concatenating and cutting: every document's ids in one long line, cut into windows of a fixed length.

The first pass encodes each document once, writes its ids and the place where they start within the partition, and
adds up one total a partition. Prefix sums over these totals turn local places into global ones. The second pass reads
the ids in the order they were written and cuts them at the windows. A window that crosses partitions leaves a boundary
record on each side; only these records are shuffled when whole sequences are wanted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from anchorline.llm.store import stored

LENGTH = 2048
# Fixed value: how byte-level vocabularies split text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters encoded, and ids cut, between two outgoing batches.
CHARACTERS = 4_000_000


class ByteEncoder:
    """Ids of a byte-level BPE vocabulary, read from its public JSON description.

    Where the merges are listed in the order of the ids they make, the ranks of a faster encoder are the ids themselves,
    and both give the same ids. Any other description is left to the library that defines it.
    """

    def __init__(self, description: str):
        told = json.loads(description)
        self.slow = Tokenizer.from_str(description)
        self.slow.no_truncation()
        self.slow.no_padding()
        model, pre = told["model"], told.get("pre_tokenizer") or {}
        ids, added = model["vocab"], told["added_tokens"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [ids[a + b] for a, b in merges]
        plain = (
            told["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex")
            and not pre.get("add_prefix_space") and model.get("end_of_word_suffix") is None
            and not (model.get("ignore_merges") or model.get("dropout"))
            and all(a < b for a, b in zip(made, made[1:], strict=False))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        )
        self.width = 2 if max([*ids.values(), *(t["id"] for t in added)]) < 1 << 16 else 4
        self.fast = None
        if plain:
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
            special = {t["content"]: t["id"] for t in added}
            ranks = {bytes(byte[c] for c in t): i for t, i in ids.items() if t not in special}
            self.fast = tiktoken.Encoding("described", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)

    def ids_of(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its splitter gives up on some texts of millions of like letters
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_LOADED: dict[int, ByteEncoder] = {}


def loaded(description: str) -> ByteEncoder:
    """The encoder, built once in each Python process."""
    key = hash(description)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteEncoder(description)
    return _LOADED[key]


def _batches(columns: list[pa.Array], names: list[str], sizes: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """Cut one long batch into batches of about ``most`` in size."""
    whole, start, weight = pa.RecordBatch.from_arrays(columns, names), 0, 0
    for n, size in enumerate(sizes, 1):
        weight += size
        if weight >= most or n == len(sizes):
            yield whole.slice(start, n - start)
            start, weight = n, 0


def encoded(docs: DataFrame, description: str, end: int) -> DataFrame:
    """First pass, written down: part, before (ids of earlier documents of the part), doc_id, n (its ids), ids (packed)."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(description)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = loaded(shared.value), TaskContext.get().partitionId(), 0
        packed = np.dtype(f"<u{encoder.width}")
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < len(texts):
                starts, counts, cells, first, letters = [], [], [], at, 0
                while at < len(texts) and letters < CHARACTERS:
                    text = texts[at].as_py() or ""
                    ids = np.append(encoder.ids_of(text), np.uint32(end)).astype(packed)
                    starts.append(before)
                    counts.append(len(ids))
                    cells.append(ids.tobytes())
                    before += len(ids)
                    letters += len(text)
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(starts), pa.int32()), pa.array(starts, pa.int64()),
                     batch.column(0).slice(first, len(starts)), pa.array(counts, pa.int64()), pa.array(cells, pa.binary())],
                    ["part", "before", "doc_id", "n", "ids"],
                )

    schema = f"part INT, before BIGINT, doc_id {kind}, n BIGINT, ids BINARY"
    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), "packing-ids")


@dataclass(frozen=True)
class Layout:
    """Ids in the order they were written, where each partition begins, and how many ids there are in all."""

    ids: DataFrame
    starts: np.ndarray
    total: int
    width: int
    length: int

    def cuts(self) -> list[int]:
        """Ends of the last sequences: what is left after the full windows, in powers of two, so that nothing is padded."""
        at, ends = self.total - self.total % self.length, []
        for bit in reversed(range(self.length.bit_length())):
            if (self.total % self.length) >> bit & 1:
                at += 1 << bit
                ends.append(at)
        return ends


def laid_out(docs: DataFrame, description: str, length: int = LENGTH, end: int = 1) -> Layout:
    """Both passes up to the global places. Only one number a partition comes to the driver."""
    if not 0 < length or not 0 <= end:
        raise ValueError("length must be positive, end must be an id")
    ids = encoded(docs, description, end)
    totals = ids.groupBy("part").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(max([r["part"] for r in totals], default=-1) + 2, np.int64)
    for r in totals:
        sums[r["part"] + 1] = r["n"]
    starts = np.cumsum(sums)
    return Layout(ids, starts[:-1], int(starts[-1]), loaded(description).width, length)


def _cut(layout: Layout, kind: str, whole: bool):
    """The second pass as a function of record batches: pieces, or sequences with their boundary records."""
    shared = layout.ids.sparkSession.sparkContext.broadcast(layout.starts)
    length, total, width = layout.length, layout.total, layout.width
    full, tail = total - total % length, np.array([total - total % length, *layout.cuts()], np.int64)

    def borders(start: int, stop: int) -> np.ndarray:
        """Where the ids from start to stop are cut, both ends included."""
        inner = np.arange(start - start % length + length, min(stop, full + 1), length)
        return np.unique(np.concatenate([[start, stop], inner, tail[(tail > start) & (tail < stop)]]))

    def place(at: int) -> tuple[int, int]:
        """Sequence and offset of a global place."""
        if at < full:
            return at // length, at % length
        n = int(np.searchsorted(tail, at, "right")) - 1
        return full // length + n, at - int(tail[n])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes = {name: [] for name in ("row", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}, []
            for n, (part, before, count, cell) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
                origin = int(shared.value[part]) + before
                ids = np.frombuffer(cell, f"<u{width}").astype("<u4")
                ends = borders(origin, origin + count).tolist()
                for a, b in zip(ends, ends[1:], strict=False):
                    sequence, offset = place(a)
                    values = (n, a - origin, b - a, count, sequence, offset, ids[a - origin : b - origin].tobytes())
                    for column, value in zip(rows.values(), values, strict=True):
                        column.append(value)
                    sizes.append(b - a)
            columns = [batch.column(2).take(pa.array(rows.pop("row"), pa.int64()))]
            columns += [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()]
            yield from _batches(columns, ["doc_id", *rows], sizes, CHARACTERS)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        opened, reached, n_held, out = 0, -1, 0, []

        def ended(at: int) -> bool:
            return place(opened)[1] == 0 and (at == total or place(at)[1] == 0)

        def record(at: int) -> None:
            sequence, offset = place(opened)
            out.append((sequence, offset, b"".join(held), not ended(at)))
            held.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sequence_id", "offset", "ids", "boundary"]
            )

        for batch in batches:
            for part, before, count, cell in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                origin = int(shared.value[part]) + before
                ids = np.frombuffer(cell, f"<u{width}").astype("<u4")
                if held and reached != origin:
                    record(reached)
                ends = borders(origin, origin + count).tolist()
                for a, b in zip(ends, ends[1:], strict=False):
                    if not held:
                        opened = a
                    held.append(ids[a - origin : b - origin].tobytes())
                    n_held += b - a
                    if b == total or place(b)[1] == 0:
                        record(b)
                reached = origin + count
                if n_held >= CHARACTERS // 4:
                    n_held = 0
                    yield flush()
        if held:
            record(reached)
        yield flush()

    if whole:
        return sequences, "sequence_id BIGINT, offset BIGINT, ids BINARY, boundary BOOLEAN"
    return pieces, (
        f"doc_id {kind}, start BIGINT, length BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT, ids BINARY"
    )


def pieces(layout: Layout) -> DataFrame:
    """One row for each run of a document's ids in a sequence.

    doc_id, start (ids of the document before it), length, doc_tokens (with the closing id), sequence_id, offset (in
    the sequence), ids (little-endian unsigned 32-bit integers). Every id lies in one piece and the pieces of a
    sequence leave no gap.
    """
    run, schema = _cut(layout, dict(layout.ids.dtypes)["doc_id"], whole=False)
    return layout.ids.mapInArrow(run, schema)


def sequences(layout: Layout) -> DataFrame:
    """sequence_id, ids (packed as in ``pieces``): whole windows as they are read, others joined from boundary records."""
    run, schema = _cut(layout, dict(layout.ids.dtypes)["doc_id"], whole=True)
    found = stored(layout.ids.mapInArrow(run, schema), "packing-sequences")
    joined = (
        found.filter("boundary").groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.expr("aggregate(parts, CAST('' AS BINARY), (a, p) -> concat(a, p.ids))").alias("ids"))
    )
    return found.filter("NOT boundary").select("sequence_id", "ids").unionByName(joined)


def pack(docs: DataFrame, description: str, length: int = LENGTH, end: int = 1) -> DataFrame:
    """The pieces of all documents, packed into sequences of ``length`` ids.

    Needs doc_id (any type) and text and ignores other columns. A null or empty text gives the closing id alone; a null
    doc_id stays null; repeated rows are documents of their own. Documents of any length are cut freely. The order is
    that of the partitions and of the rows within them. All sequences are full but the last few, which hold the rest
    in powers of two, so none needs padding. ``description`` is the JSON text of a public tokenizer; strings of its
    special tokens inside a text become those tokens, as in the library it is made for.
    """
    return pieces(laid_out(docs, description, length, end))
