"""Substring deduplication by hashing lines and sentences.

Each line, and each sentence of a line that has several, is normalised and hashed. Digests are grouped over the whole
corpus; the earliest occurrence stays and the others are cut out of their texts, with their original offsets kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.phrase_index import row_key

LINE = re.compile(r"[^\n]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")


def units(text: str, least: int, least_line: int) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and 16-byte digest of each unit, normalised to lower-case words.

    Whole lines have at least ``least_line`` words, sentences of a line that has several at least ``least``.
    """
    for line in LINE.finditer(text):
        parts = []
        for found in SENTENCE.finditer(line.group()):
            words = WORD.findall(found.group().lower())
            if words:
                parts.append((line.start() + found.start(), line.start() + found.end(), words))
        whole = [w for _, _, words in parts for w in words]
        if len(parts) > 1 and len(whole) >= least_line:
            yield line.start(), line.end(), _digest(whole)
        for start, end, words in parts:
            if len(words) >= (least if len(parts) > 1 else least_line):
                yield start, end, _digest(words)


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def unit_table(docs: DataFrame, least: int, least_line: int) -> DataFrame:
    """doc_id, row, h, g (the digest), start, stop (characters) of every unit."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                of, h, g, start, stop = [], [], [], [], []
                for n, text in enumerate(batch.column(2)):
                    for a, b, digest in units(text.as_py() or "", least, least_line):
                        of.append(n), start.append(a), stop.append(b)
                        h.append(int.from_bytes(digest[:8], "little", signed=True))
                        g.append(int.from_bytes(digest[8:], "little", signed=True))
                of = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), pa.array(h, pa.int64()), pa.array(g, pa.int64()),
                     pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
                    ["doc_id", "row", "h", "g", "start", "stop"],
                )

    return docs.select("doc_id", row_key().alias("row"), "text").mapInArrow(
        run, f"doc_id {kind}, row BIGINT, h BIGINT, g BIGINT, start INT, stop INT"
    )


def repeated_units(docs: DataFrame, least: int = 6, least_line: int | None = None) -> DataFrame:
    """Units that repeat an earlier one: row, start, stop, first (doc_id, start of the earliest)."""
    found = unit_table(docs, least, least if least_line is None else least_line)
    firsts = found.groupBy("h", "g").agg(
        F.min(F.struct("doc_id", "row", "start")).alias("first"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") > 1).select("h", "g", "first")
    return found.join(firsts, ["h", "g"]).filter(F.col("first") != F.struct("doc_id", "row", "start")).select(
        "row", "start", "stop", F.struct("first.doc_id", "first.start").alias("first")
    )


def _cut(text: str, spans: list[dict]) -> str:
    kept, at = [], 0
    for span in spans:
        if span["start"] > at:
            kept.append(text[at : span["start"]])
        at = max(at, span["stop"])
    kept.append(text[at:])
    return "".join(kept)


def dedup_units(docs: DataFrame, least: int = 6, least_line: int | None = None) -> DataFrame:
    """doc_id, kept (the text without repeated units), removed (start, stop, first: doc_id and start of the original).

    Offsets are characters of the original text, sorted; a removed line also lists its removed sentences. What stays
    are lines under ``least_line`` words (``least`` if not given), and sentences under ``least`` words of a line that
    has several and does not repeat as a whole; such sentences are no originals either. Earlier means by doc_id (null ids first), a hash of the row, then offset. A null text stays
    null; rows equal in doc_id and text are one document and come out alike; other columns are ignored.
    """
    per_row = repeated_units(docs, least, least_line).groupBy(F.col("row").alias("__row")).agg(
        F.array_sort(F.collect_set(F.struct("start", "stop", "first"))).alias("removed")
    )
    kind = dict(docs.dtypes)["doc_id"]
    spans = f"ARRAY<STRUCT<start: INT, stop: INT, first: STRUCT<doc_id: {kind}, start: INT>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                kept = [
                    t if t is None or not s else _cut(t, s)
                    for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), batch.column(2)], ["doc_id", "kept", "removed"])

    joined = docs.select("doc_id", row_key().alias("__row"), "text").join(per_row, "__row", "left").select(
        "doc_id", "text", F.coalesce("removed", F.expr(f"CAST(array() AS {spans})")).alias("removed")
    )
    return joined.mapInArrow(run, f"doc_id {kind}, kept STRING, removed {spans}")
