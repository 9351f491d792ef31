"""Global order without a single task: running totals, row numbers, equal-count bins.

Rows are dealt into ranges of the full sort key, so a value shared by many rows is split by the
rest of the key. Ranges are frozen: running totals keep them in a checkpoint, row numbers in a table. Each range is then
summed on its own and shifted by the totals of the ranges before it, a table with one row per
range (and group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.session import materialize, stored

RANGE, PLACE = "_range", "_place"


def in_ranges(df: DataFrame, order: list[str], groups: list[str] | None = None) -> DataFrame:
    """Rows tagged with the number of their key range; ranges are in key order and stay fixed."""
    keys = [F.col(c) for c in [*(groups or []), *order]]
    return materialize(df.repartitionByRange(*keys).withColumn(RANGE, F.spark_partition_id()))


def running_totals(
    df: DataFrame, order: list[str], sums: dict[str, Column], groups: list[str] | None = None
) -> DataFrame:
    """Add ``<name>_upto`` (inclusive running sum) and ``<name>_all`` (group sum) per entry of ``sums``.

    ``order`` must order the rows of a group totally.
    """
    groups = list(groups or [])
    ranged = in_ranges(df.withColumns({f"_w_{n}": c for n, c in sums.items()}), order, groups)
    totals = ranged.groupBy(*groups, RANGE).agg(*[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in sums])
    # One row per range and group: small by construction.
    earlier = Window.partitionBy(*groups).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    carried = totals.select(
        *groups, RANGE,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_all") for n in sums],
    )
    inside = Window.partitionBy(*groups, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(f"_w_{n}").over(inside).alias(f"_l_{n}") for n in sums])
    return local.join(carried, [*groups, RANGE]).withColumns(
        {f"{n}_upto": F.col(f"_c_{n}") + F.col(f"_l_{n}") for n in sums}
    ).drop(RANGE, *[f"{p}{n}" for n in sums for p in ("_w_", "_c_", "_l_")])


def with_row_number(
    df: DataFrame, order: list[str], name: str = "row_number", groups: list[str] | None = None, total: str | None = None
) -> DataFrame:
    """A gap-free position from 1 in the total order, per group; ``total`` names the group size.

    Without groups the rows cross one exchange into ranges of the order, are sorted there and written down with their
    place in the range. Ranges are then counted from what is written, so the rows themselves are worked out once.
    """
    if groups:
        out = running_totals(df, order, {"_n": F.lit(1)}, groups)
        out = out.withColumnRenamed("_n_upto", name)
        return out.withColumnRenamed("_n_all", total) if total else out.drop("_n_all")
    # The low 33 bits of the increasing id are the position in the partition, which is one range.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumns({RANGE: F.spark_partition_id(), PLACE: place}), "numbered")
    # One number a range.
    counts = {r[RANGE]: r["n"] for r in placed.groupBy(RANGE).agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for n in range(1 + max(counts, default=-1)):
        starts.append(at)
        at += counts.get(n, 0)
    start = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col(RANGE)) if starts else F.lit(0).cast("long")
    out = placed.withColumn(name, start + F.col(PLACE) + 1).drop(RANGE, PLACE)
    return out.withColumn(total, F.lit(at).cast("long")) if total else out


def bin_end(index: Column, total: Column, bins: int) -> Column:
    """How many rows the bins 1..index hold together."""
    used = F.least(F.lit(bins).cast("long"), total)
    return index * F.floor(total / used) + F.least(index.cast("long"), total % used)


def bin_of(position: Column, total: Column, bins: int) -> Column:
    """The equal-count bin, from 1, of the row at a position from 1.

    The first ``total % bins`` bins hold one row more; with fewer rows than bins each row is one.
    """
    used = F.least(F.lit(bins).cast("long"), total)
    small = F.floor(total / used)
    large_rows = (total % used) * (small + 1)
    zero = position - 1
    return (
        F.when(zero < large_rows, F.floor(zero / (small + 1)))
        .otherwise(total % used + F.floor((zero - large_rows) / small))
        .cast("int")
        + 1
    )


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], groups: list[str] | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per group, from counts per distinct value.

    The built-in exact percentile keeps every distinct value of a group in one task; this one
    reads each quantile's two neighbours from running counts.
    """
    groups = list(groups or [])
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_k"))
    run = running_totals(counts, [value], {"_k": F.col("_k")}, groups)
    below = F.col("_k_upto") - F.col("_k")
    aggregates = []
    for name, p in probabilities.items():
        rank = F.lit(float(p)) * (F.col("_k_all") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            aggregates.append(F.max(F.when((below <= at) & (at < F.col("_k_upto")), F.col(value))).alias(f"{name}_{side}"))
        aggregates.append(F.max(rank - F.floor(rank)).alias(f"{name}_f"))
    picked = run.groupBy(*groups).agg(F.max("_k_all").alias("count"), *aggregates)
    return picked.select(
        *groups, "count",
        *[(F.col(f"{n}_lo") + F.col(f"{n}_f") * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))).alias(n) for n in probabilities],
    )
