"""Idempotent recording: duplicates are dropped, contradictions are named, the first row stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.operators.joins import differing_columns, missing_rows


def first_per_key(df: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The first arrival per key, with the number of copies and whether any of them differ.

    Copies are reduced before rows move, so a key that repeats without bound stays cheap.
    """
    values = [c for c in df.columns if c not in key]
    content = [c for c in values if c not in seq]
    body = F.struct(*content) if content else F.lit(0)
    out = df.groupBy(*key).agg(
        F.min_by(F.struct(*values), F.struct(*seq)).alias("_first"),
        F.count("*").alias("copies"),
        (~F.min(body).eqNullSafe(F.max(body))).alias("conflicting"),
    )
    return out.select(*key, "_first.*", "copies", "conflicting")


def compare_to_stored(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Each incoming row marked new, duplicate or conflict, with the differing column names.

    ``stored`` is unique on the key. Stored values are never copied to the result.
    """
    values = [c for c in incoming.columns if c not in key]
    theirs = stored.select(*key, *values, F.lit(True).alias("_stored"))
    joined = incoming.alias("i").join(theirs.alias("s"), key, "left")
    differs = differing_columns(values, "i", "s")
    return joined.select(
        *key,
        *[F.col(f"i.{c}") for c in values],
        F.when(F.col("_stored").isNull(), F.array().cast("array<string>")).otherwise(differs).alias("differing"),
        F.when(F.col("_stored").isNull(), "new").when(F.size(differs) > 0, "conflict").otherwise("duplicate").alias(
            "status"
        ),
    )


def new_rows(incoming: DataFrame, stored: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The rows of a batch to append: the first arrival of every key that is not stored."""
    values = [c for c in incoming.columns if c not in key and c not in seq]
    first = first_per_key(incoming, key, seq).select(*key, *values, *seq)
    return missing_rows(first, stored, key)


def conflicts_with(incoming: DataFrame, stored: DataFrame, new: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """Rows of a batch that contradict what is stored or the batch's own ``new_rows``."""
    values = [c for c in incoming.columns if c not in key and c not in seq]
    known = stored.select(*key, *values).unionByName(new.select(*key, *values))
    compared = compare_to_stored(incoming.select(*key, *values), known, key)
    return compared.filter(F.col("status") == "conflict").drop("status").distinct()


def record_batch(
    incoming: DataFrame, stored: DataFrame, key: list[str], seq: list[str]
) -> tuple[DataFrame, DataFrame]:
    """New rows to append, and the conflicts of a batch.

    Within the batch the first arrival stands too; a later, different row of the same key is a
    conflict against it.
    """
    new = new_rows(incoming, stored, key, seq)
    return new, conflicts_with(incoming, stored, new, key, seq)


def mark_within_cap(
    events: DataFrame, *, entity: str, order: list[str], limit: int, held: DataFrame | None = None, slice_of: Column | None = None
) -> DataFrame:
    """Every event with ``fits``: whether its entity holds fewer than ``limit`` rows before it, in the given total order.

    ``held`` has the rows each entity already holds (``entity``, ``rows``). ``slice_of`` is a coarse value that never
    falls along the order (by default its first column; of a text the first ten letters, the day of an ISO instant):
    counts per entity and slice, summed up slice by slice, say in which slice the limit falls, and only rows of that slice are
    sorted. An entity over the limit is one row of the table that events look up.
    """
    at = slice_of
    if at is None:
        at = F.substring(order[0], 1, 10) if dict(events.dtypes)[order[0]] == "string" else F.col(order[0])
    counts = events.groupBy(entity, at.alias("_slice")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(entity).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("_upto", F.sum("_n").over(upto))
    room = F.lit(limit)
    if held is not None:
        summed = summed.join(held.select(entity, F.col("rows").alias("_held")), entity, "left")
        room = F.lit(limit) - F.coalesce("_held", F.lit(0))
    cuts = summed.filter(F.col("_upto") > room).groupBy(F.col(entity).alias("_over")).agg(
        F.min(F.struct("_slice", F.greatest(F.lit(0), room - F.col("_upto") + F.col("_n")).alias("room"))).alias("_cut")
    )
    # One row an entity at most is held in memory; events pass by it unsorted.
    looked = lambda how: events.withColumn("_at", at).join(cuts.hint("shuffle_hash"), F.col(entity) == F.col("_over"), how)
    # A missing instant comes first in every order.
    earlier = F.when(F.col("_over").isNull(), True).when(F.col("_cut._slice").isNull(), False).otherwise(
        F.coalesce(F.col("_at") < F.col("_cut._slice"), F.lit(True))
    )
    settled = looked("left").filter("_over IS NULL OR NOT (_at <=> _cut._slice)").select(*events.columns, earlier.alias("fits"))
    ranked = Window.partitionBy(entity).orderBy(*order)
    split = looked("inner").filter("_at <=> _cut._slice").withColumn("_rank", F.row_number().over(ranked)).select(
        *events.columns, (F.col("_rank") <= F.col("_cut.room")).alias("fits")
    )
    return settled.unionByName(split)


def cap_per_entity(
    events: DataFrame, *, entity: str, order: list[str], limit: int, held: DataFrame | None = None, slice_of: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Accepted and refused events when an entity may hold at most ``limit`` rows; see ``mark_within_cap``."""
    marked = mark_within_cap(events, entity=entity, order=order, limit=limit, held=held, slice_of=slice_of)
    return marked.filter("fits").drop("fits"), marked.filter("NOT fits").drop("fits")
