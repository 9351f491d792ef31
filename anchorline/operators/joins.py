"""Keyed joins with the checks the pipeline relies on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def checked_lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a table that must be unique on its key; a repeated key raises.

    The right side is reduced per key before the join, so a repeated key can never multiply
    rows. Which strategy joins them is left to the optimizer: it broadcasts only a side whose
    measured size is under the session's limit, and splits hot keys of the left side otherwise.
    """
    payload = [c for c in right.columns if c not in keys]
    unique = right.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.first(c).alias(c) for c in payload]
    )
    message = F.concat(F.lit("lookup key is not unique: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    guarded = unique.select(
        *keys, *[F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col(c)).alias(c) for c in payload]
    )
    return left.join(guarded, keys, "left")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def restrict_to_entities(frames: dict[str, DataFrame], ids: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Every row of the chosen entities in each table."""
    column = ids.columns[0]
    chosen = ids.distinct()
    return {
        name: df.join(chosen.withColumnRenamed(column, "_chosen"), F.col(keys[name]) == F.col("_chosen"), "left_semi")
        for name, df in frames.items()
    }


def missing_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a match."""
    return left.join(right.select(*keys), keys, "left_anti")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*left.columns).subtract(right.select(*left.columns))


def differing_columns(columns: list[str], left: str, right: str) -> Column:
    """Names of the columns whose values differ between two aliased sides, NULL-safe."""
    named = [
        F.when(~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")), F.lit(c)) for c in columns
    ]
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def table_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with both counts; empty when the tables are equal.

    Copies are counted on each side before rows move, so a heavily repeated row stays cheap.
    """
    columns = left.columns
    tagged = left.withColumns({"_l": F.lit(1), "_r": F.lit(0)}).unionByName(
        right.select(*columns).withColumns({"_l": F.lit(0), "_r": F.lit(1)})
    )
    return (
        tagged.groupBy(*columns)
        .agg(F.sum("_l").alias("left_copies"), F.sum("_r").alias("right_copies"))
        .filter(F.col("left_copies") != F.col("right_copies"))
    )


def keyed_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ, with the names of the differing columns.

    A key found on one side only reports ``missing_left`` or ``missing_right``.
    """
    values = [c for c in left.columns if c not in keys]
    l, r = left.withColumn("_here", F.lit(True)).alias("l"), right.withColumn("_here", F.lit(True)).alias("r")
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    joined = l.join(r, on, "full")
    return joined.select(
        *[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys],
        F.when(F.col("l._here").isNull(), F.array(F.lit("missing_left")))
        .when(F.col("r._here").isNull(), F.array(F.lit("missing_right")))
        .otherwise(differing_columns(values, "l", "r"))
        .alias("differences"),
    ).filter(F.size("differences") > 0)
