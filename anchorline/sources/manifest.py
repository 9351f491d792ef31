"""Checksums of a folder of files, and their verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK = 1 << 23


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, size and lines of each file, read once and in pieces."""
    for batch in batches:
        digests, sizes, lines = [], [], []
        for uri in batch.column(0).to_pylist():
            system, path = fs.FileSystem.from_uri(uri)
            digest, size, breaks, last = hashlib.sha256(), 0, 0, b"\n"
            with system.open_input_stream(path, compression=None) as stream:
                while piece := stream.read(CHUNK):
                    digest.update(piece)
                    size += len(piece)
                    breaks += piece.count(b"\n")
                    last = piece[-1:]
            digests.append(digest.hexdigest()), sizes.append(size), lines.append(breaks + (last != b"\n"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(lines, pa.int64())],
            ["uri", "sha256", "bytes", "lines"],
        )


def build_manifest(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """path, sha256, bytes and data rows (lines less the header) of every matching file, of any size."""
    # The file index lists empty files too, which a scan skips.
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    listed = sorted(files.inputFiles())
    uris = spark.createDataFrame([(f,) for f in listed], "uri STRING").repartition(max(1, len(listed)))
    name = F.regexp_replace(F.regexp_replace("uri", "^[a-z]+:/+", "/"), f"^{folder.rstrip('/')}/", "")
    measured = uris.mapInArrow(_measured, "uri STRING, sha256 STRING, bytes BIGINT, lines BIGINT")
    return measured.select(name.alias("path"), "sha256", "bytes", F.greatest(F.col("lines") - 1, F.lit(0)).alias("rows"))


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Discrepancies as (path, problem): missing file, extra file, size or checksum mismatch, unverified (no digest)."""
    told = lambda df, mark: df.select("path", F.struct("sha256", "bytes").alias(mark))
    marked = told(expected, "_e").join(told(actual, "_a"), "path", "full")
    problem = (
        F.when(F.col("_a").isNull(), "missing file")
        .when(F.col("_e").isNull(), "extra file")
        .when(F.col("_e.bytes") != F.col("_a.bytes"), "size mismatch")
        .when(F.col("_e.sha256").isNull() | F.col("_a.sha256").isNull(), "unverified")
        .when(F.col("_e.sha256") != F.col("_a.sha256"), "checksum mismatch")
    )
    return marked.select("path", problem.alias("problem")).filter(F.col("problem").isNotNull())
