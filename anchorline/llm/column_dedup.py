"""Removal of repeated byte strings by column-wise suffix sorting.

Two equal strings of the wanted length hold the same least 16-gram at the same offset, its anchor. So only documents
around equal anchors need comparing, and they can be laid under one another with the anchors in one column. Each such
collection is sorted from its last column to its first: a round reads one symbol of every row from a file of columns,
keeps the rows in the order of their suffixes (which is the Burrows-Wheeler transform of that column), and updates the
common prefix of each row with the row above. Where it reaches the length, the string occurs twice.

Inserting symbols of whole documents this way takes as many rounds as the longest has bytes, with the whole collection
read in each. Aligned at anchors, twice the length is enough.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from anchorline.llm.phrase_index import row_key
from anchorline.llm.store import stored

GRAM = 16
PIECE = 1_000_000
CELL = 24
# Contexts that are sorted together: their table of symbols takes 4 MB. Larger collections are told apart by longer
# common strings first.
CROWD = 5000
OUTSIDE = 256


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes that start at each position."""
    h = data.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def anchors_of(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of all strings of ``length`` bytes: hash, position, first and last start of the strings it stands for."""
    span = length - GRAM + 1
    for at in range(0, len(data) - length + 1, PIECE):
        part = data[at : at + PIECE + length - 1]
        hashes = gram_hashes(part)
        # The hash above, the place below: of equal hashes the leftmost counts.
        keys = (hashes & ~np.uint64((1 << 21) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(keys)] = keys
        table = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - length + 1
        place = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], n] - 1
        yield hashes[place[first]].view(np.int64), place[first] + at, first + at, last + at


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """key, row, pos, first, last of every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = batch.column(0).to_numpy()
                out = [(np.zeros(0, np.int64),) * 5]
                for row, text in zip(rows, batch.column(1), strict=True):
                    data = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                    for key, pos, first, last in anchors_of(data, length):
                        out.append((key, np.full(len(key), row, np.int64), pos, first, last))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "row", "pos", "first", "last"])

    return docs.select(row_key().alias("row"), "text").mapInArrow(run, "key BIGINT, row BIGINT, pos BIGINT, first BIGINT, last BIGINT")


CONTEXT = "key BIGINT, crowded BOOLEAN, row BIGINT, pos BIGINT, first BIGINT, last BIGINT, data BINARY"


def contexts(docs: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """The bytes of all strings of each anchor that has another of its kind; crowded tells of many of its kind."""
    equal = stored(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "column-keys")
    per_row = anchors.join(equal, "key").groupBy("row").agg(F.collect_list(F.struct("key", "n", "pos", "first", "last")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 32):
                batch = whole.slice(at, 32)
                out: list[tuple] = []
                for row, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    for a in found:
                        first, last = a["first"], a["last"]
                        out.append((a["key"], a["n"] > CROWD, row, a["pos"], first, last, data[first : last + length]))
                yield _batch(out)

    joined = docs.select(row_key().alias("row"), "text").join(per_row, "row").select("row", "text", "found")
    return joined.mapInArrow(run, CONTEXT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["key", "crowded", "row", "pos", "first", "last", "data"]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _cells(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Deal the strings of contexts into cells of CELL neighbouring starts; the key hashes the bytes they all share.

    Here ``crowded`` says on as before whether the context is the only one of its kind.
    """
    for batch in batches:
        out = []
        for _, single, row, pos, first, last, data in zip(*(batch.column(n).to_pylist() for n in range(7)), strict=True):
            base = pos - length + GRAM
            for cell in range((first - base) // CELL, (last - base) // CELL + 1):
                low = base + cell * CELL
                shared = data[low + CELL - 1 - first : low + length - first]
                key = int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=b"%d" % cell).digest(), "little", signed=True)
                one, two = max(first, low), min(last, low + CELL - 1)
                out.append((key, single, row, pos, one, two, data[one - first : two + length - first]))
        yield _batch(out)


def repeated_starts(group: np.ndarray, shift: np.ndarray, data: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sort aligned contexts column by column; for each start column, the rows whose string another row of their group has.

    ``group`` numbers the collections (rows of one stand together), ``shift`` is the column of each row's first byte.
    """
    columns, rows = 2 * length - GRAM, len(data)
    table = np.full((rows, columns), OUTSIDE, np.uint16)
    for n, (at, found) in enumerate(zip(shift.tolist(), data, strict=True)):
        table[n, at : at + len(found)] = np.frombuffer(found, np.uint8)
    with tempfile.TemporaryFile() as file:
        # The last column first, as the rounds read it.
        np.ascontiguousarray(table[:, ::-1].T).tofile(file)
        del table
        file.seek(0)
        order = np.arange(rows)
        common = np.zeros(rows + 1, np.int32)
        for column in range(columns - 1, -1, -1):
            symbol = np.frombuffer(file.read(2 * rows), np.uint16)[order]
            key = group[order] * np.int64(512) + symbol
            move = np.argsort(key, kind="stable")
            key = key[move]
            same = np.flatnonzero(key[1:] == key[:-1]) + 1
            longer = np.zeros(rows + 1, np.int32)
            if len(same):
                bounds = np.empty(2 * len(same), np.int64)
                bounds[::2], bounds[1::2] = move[same - 1] + 1, move[same] + 1
                longer[same] = 1 + np.minimum.reduceat(common, bounds)[::2]
            order, common = order[move], longer
            if column < length - GRAM + 1:
                yield column, order[np.maximum(common[:-1], common[1:]) >= length]


def _ranges(rows: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge neighbouring starts of each row into byte ranges."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + 1)] if len(rows) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(rows)] - 1 if len(rows) else begin
    return rows[begin], starts[begin], starts[end] + length


def _sorted_blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Whole collections at a time: the rows arrive sorted by key."""
    rest: pa.Table | None = None

    def done(table: pa.Table) -> pa.RecordBatch:
        key, row, pos, first, last = (table.column(c).to_numpy() for c in ("key", "row", "pos", "first", "last"))
        group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        base = pos - (length - GRAM)
        at, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for column, hit in repeated_starts(group, first - base, table.column("data").to_pylist(), length):
            start = base[hit] + column
            hit, start = hit[(start >= first[hit]) & (start <= last[hit])], start[(start >= first[hit]) & (start <= last[hit])]
            at.append(row[hit]), starts.append(start)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _ranges(np.concatenate(at), np.concatenate(starts), length)], ["row", "start", "stop"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        key = table.column("key").to_numpy()
        end = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if end:
            yield done(table.slice(0, end))
        rest = table.slice(end)
    if rest is not None and rest.num_rows:
        yield done(rest)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every string of contexts whose cell is crowded too, as a digest."""
    for batch in batches:
        h, g, rows, starts, singles = [], [], [], [], []
        for row, first, last, data, single in zip(*(batch.column(n).to_pylist() for n in range(5)), strict=True):
            for start in range(first, last + 1):
                digest = hashlib.blake2b(data[start - first : start - first + length], digest_size=16).digest()
                h.append(int.from_bytes(digest[:8], "little", signed=True)), g.append(int.from_bytes(digest[8:], "little", signed=True))
                rows.append(row), starts.append(start), singles.append(single)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in (h, g, rows, starts)), pa.array(singles, pa.bool_())], ["h", "g", "row", "start", "single"]
        )


def gathered(crowd: DataFrame, length: int) -> DataFrame:
    """row, h, g, places (start, stop): equal contexts of one text in one row, however often the text repeats them."""
    place = F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    return crowd.groupBy("row", "h", "g").agg(F.collect_list(place).alias("places"))


def runs_of(places: str) -> Column:
    """The maximal runs of places (start, stop) of one size: sorted, their stops ascend with their starts."""
    return F.expr(f"""transform(array(array_sort({places})), s -> zip_with(
        filter(s, (p, i) -> coalesce(p.start > get(s, i - 1).stop, true)),
        filter(s, (p, i) -> coalesce(get(s, i + 1).start > p.stop, true)),
        (a, b) -> struct(a.start AS start, b.stop AS stop)))[0]""")


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """row, start, stop: byte ranges made of strings that start anywhere else too; ranges may touch or overlap.

    Three exact ways, by how many share a key. Collections of up to CROWD contexts are sorted. In larger ones equal
    contexts settle each other, and one of each is dealt into cells, whose collections are sorted if they are small
    enough. Strings of cells that are crowded still are counted by digest, which combines before it shuffles.
    """
    anchors = stored(anchor_table(docs, length), "column-anchors")
    found = stored(contexts(docs, anchors, length), "column-contexts")
    fields = ["key", "row", "pos", "first", "last", "data"]
    alike = ["key", F.col("first") - F.col("pos"), F.col("last") - F.col("pos"), "data"]
    crowd = found.filter("crowded").withColumns({"h": F.xxhash64(*alike), "g": F.xxhash64(F.lit("again"), *alike)})
    kinds = stored(
        crowd.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "pos", "first", "last", "data")).alias("f")),
        "column-kinds",
    )
    # An inner join, since a semi join would be moved below the gathering; a kind is there once.
    settled = gathered(crowd, length).join(kinds.filter("c > 1").select("h", "g"), ["h", "g"]).select("row", F.inline(runs_of("places")))
    cells = stored(
        kinds.select(F.col("h").alias("key"), (F.col("c") == 1).alias("crowded"), "f.row", "f.pos", "f.first", "f.last", "f.data")
        .mapInArrow(partial(_cells, length=length), CONTEXT),
        "column-cells",
    )
    sizes = stored(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "column-sizes")
    marked = cells.join(sizes, "key")
    blocks = found.filter("NOT crowded").select(*fields).unionByName(marked.filter(F.col("n") <= CROWD).select(*fields))
    sorted_out = blocks.repartition("key").sortWithinPartitions("key").mapInArrow(
        partial(_sorted_blocks, length=length), "row BIGINT, start BIGINT, stop BIGINT"
    )
    strings = stored(
        marked.filter(F.col("n") > CROWD).select("row", "first", "last", "data", "crowded").mapInArrow(
            partial(_windows, length=length), "h BIGINT, g BIGINT, row BIGINT, start BIGINT, single BOOLEAN"
        ),
        "column-strings",
    )
    twice = stored(strings.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("h", "g"), "column-twice")
    # Strings of contexts with copies are settled.
    hot = strings.filter("single").join(twice, ["h", "g"], "left_semi").select(
        "row", "start", (F.col("start") + length).alias("stop")
    )
    return stored(sorted_out.unionByName(settled).unionByName(hot), "column-ranges")


def dedup_bytes(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining UTF-8 bytes), removed (start, stop of each maximal run, in bytes).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same or another text;
    strings are judged on the input. Matches never cross documents. A null text counts as empty, texts under
    ``length`` bytes stay whole, equal rows repeat each other, and other columns are ignored.
    """
    per_row = repeated_ranges(docs, length).groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    kind = dict(docs.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, kept, removed = [], [], []
                for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    data, runs = (text or "").encode("utf-8", "surrogatepass"), []
                    for r in sorted((r["start"], r["stop"]) for r in ranges or ()):
                        if runs and r[0] <= runs[-1]["stop"]:
                            runs[-1]["stop"] = max(runs[-1]["stop"], r[1])
                        else:
                            runs.append({"start": r[0], "stop": r[1]})
                    stays = zip([0, *(r["stop"] for r in runs)], [*(r["start"] for r in runs), len(data)], strict=True)
                    sizes.append(len(data)), removed.append(runs), kept.append(b"".join(data[a:b] for a, b in stays))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, span)],
                    ["doc_id", "n_bytes", "kept", "removed"],
                )

    return docs.select("doc_id", row_key().alias("row"), "text").join(per_row, "row", "left").select("doc_id", "text", "ranges").mapInArrow(
        run, f"doc_id {kind}, n_bytes BIGINT, kept BINARY, removed ARRAY<STRUCT<start: BIGINT, stop: BIGINT>>"
    )
