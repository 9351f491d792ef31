"""Reading raw text tables, and their typed views."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorline.contracts import TABLES, TableContract
from anchorline.functions.hashing import rekey
from anchorline.functions.scalar import parse_date, parse_instant
from anchorline.session import prepare


def load_population(
    spark: SparkSession, csv_dir: str, *, frames: Sequence[str] = tuple(TABLES), line_breaks: bool = False
) -> dict[str, DataFrame]:
    """A folder of CSV exports as raw tables. Only known tables can be asked for; see ``read_table``."""
    wanted = [TABLES.get(name) for name in frames]
    if None in wanted:
        raise ValueError(f"{list(frames)} must be among {sorted(TABLES)}")
    session = prepare(spark)
    return {table.name: read_table(session, os.path.join(csv_dir, f"{table.name}.csv"), table, line_breaks) for table in wanted}


def read_table(spark: SparkSession, path: str, contract: TableContract, line_breaks: bool = False) -> DataFrame:
    """One CSV table as text; a missing value is empty text.

    Columns go by header name and must include the contract's. Quotes inside quotes are doubled. A row with more or fewer
    cells than the header fails the read, and so does a line break inside a cell unless ``line_breaks`` allows it: such a
    file cannot be split and is one task, others are read in splits whatever their size.
    """
    found = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks).option("mode", "FAILFAST")
        .option("columnPruning", False).csv(path)
    )
    lacking = [c for c in contract.payload if c not in found.columns]
    if found.columns and lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    return found.na.fill("") if found.columns else found


def typed(raw: DataFrame, contract: TableContract, *, strict: bool = False) -> DataFrame:
    """Typed view of a raw table: ids as text, times as timestamps or dates, empty times NULL.

    A time that does not parse is NULL; with ``strict`` it raises instead.
    """
    parse = parse_date if contract.name in ("patients", "conditions") else parse_instant

    def time(name: str):
        value = parse(F.nullif(F.col(name), F.lit("")))
        if not strict:
            return value
        message = F.concat(F.lit(f"{contract.name} {name} does not match {contract.time_pattern}: "), F.col(name))
        broken = value.isNull() & (F.lit(name in contract.required_times) | (F.col(name) != ""))
        return F.when(broken, F.raise_error(message).cast("timestamp").cast(
            "date" if parse is parse_date else "timestamp")).otherwise(value)

    if contract.name == "patients":
        gender = [F.col("GENDER").alias("gender")] if "GENDER" in raw.columns else []
        return raw.select(
            F.col("Id").alias("id"), time("BIRTHDATE").alias("birthdate"), time("DEATHDATE").alias("deathdate"), *gender
        )
    interval = [time("START").alias("start"), time("STOP").alias("stop")]
    if contract.name == "encounters":
        return raw.select(
            F.col("Id").alias("id"), F.col("PATIENT").alias("patient"), *interval,
            F.col("ENCOUNTERCLASS").alias("encounter_class"),
        )
    keys = [F.col("PATIENT").alias("patient"), F.col("ENCOUNTER").alias("encounter"), F.col("CODE").alias("code")]
    if contract.name == "medications":
        return raw.select(*keys, *interval)
    return raw.select(*keys, *interval, F.col("SYSTEM").alias("system"), F.col("DESCRIPTION").alias("description"))


def typed_population(raw: dict[str, DataFrame], *, strict: bool = False) -> dict[str, DataFrame]:
    return {name: typed(df, TABLES[name], strict=strict) for name, df in raw.items()}


def rekeyed(raw: dict[str, DataFrame], population: str) -> dict[str, DataFrame]:
    """The tables with patient and encounter ids rewritten under a population name."""
    return {
        name: df.withColumns({c: rekey(population, F.col(c)) for c in TABLES[name].ids}) if name in TABLES else df
        for name, df in raw.items()
    }
