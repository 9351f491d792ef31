"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorline.llm.store import stored


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Connect each node's neighbours (those above it, or it and those below it) to the least of them."""
    if larger:
        around = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    joined = around.join(least, "a")
    if larger:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge: root is the least node that can be reached.

    ``edges`` holds a and b; nulls and loops are left out. Alternates two kinds of local rewiring, each of which only
    groups a node's own edges, until nothing changes; the number of rounds grows with the logarithm of the paths.
    """
    state = stored(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "components")
    print_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = print_of(state)
    while mark[0]:
        after = stored(_star(_star(state, True), False), "components")
        now = print_of(after)
        state, same, mark = after, now == mark, now
        if same:
            break
    roots = state.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
