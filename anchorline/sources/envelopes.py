"""Event envelopes: one JSON object per line, ``{"event_type": ..., "payload": {...}}``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorline.contracts import BY_KIND, TABLES
from anchorline.functions.hashing import canonical_event
from anchorline.operators.order import arrival
from anchorline.operators.validate import row_errors, shape_error

FIELDS = sorted({c for t in TABLES.values() for c in t.payload})


def write_envelopes(raw: dict[str, DataFrame]) -> DataFrame:
    """Raw tables as event lines with the contract's columns only."""
    lines = [
        df.select(canonical_event(TABLES[n].kind, {c: F.col(c) for c in TABLES[n].payload}).alias("value"))
        for n, df in raw.items()
    ]
    return reduce(DataFrame.unionByName, lines)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def parse_envelopes(lines: DataFrame) -> DataFrame:
    """Every line with its kind, payload fields, arrival key, input hash and ``errors``.

    Works on batch and streaming frames alike. A row with errors belongs in quarantine.
    """
    schema = "event_type STRING, payload STRUCT<" + ", ".join(f"{c}: STRING" for c in FIELDS) + ">"
    # Each step is read from a generated row: a filter on the result would otherwise move below the steps and parse the
    # line anew for every field that it reads.
    parsed = lines.select("value", F.inline(F.array(F.from_json("value", schema)))).select(
        "value", F.col("event_type").alias("kind"), *[F.col(f"payload.{c}").alias(c) for c in FIELDS]
    )
    written, entity, at, errors = (F.lit(None).cast(t) for t in ("string", "string", "string", "array<string>"))
    whole = F.lit(False)
    for kind, contract in BY_KIND.items():
        here = F.col("kind") == kind
        # A missing field is left out of the JSON.
        whole = whole | (here & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in contract.payload]))
        written = F.when(here, canonical_event(kind, {c: F.col(c) for c in contract.payload})).otherwise(written)
        errors = F.when(here, row_errors(contract)).otherwise(errors)
        entity = F.when(here, F.col(contract.entity)).otherwise(entity)
        if kind != "patient":
            at = F.when(here, arrival(kind)).otherwise(at)
    once = parsed.select("*", F.inline(F.array(F.struct(written.alias("_written")))))
    # A line that reads as its own canonical form has the right shape; only others are looked at field by field.
    shape = F.when(F.coalesce(whole & (F.col("_written") == F.col("value")), F.lit(False)), None).otherwise(shape_error(F.col("value")))
    told = once.select("*", F.inline(F.array(F.struct(shape.alias("_shape")))))
    told = told.select("*", F.inline(F.array(F.struct(
        F.when(F.col("_shape").isNotNull(), F.array("_shape")).otherwise(F.coalesce(errors, F.array(F.lit("unknown_kind")))).alias("errors")
    ))))
    return told.select("value", "kind", entity.alias("entity"), at.alias("at"), *FIELDS, F.sha2("_written", 256).alias("input_hash"), "errors")
