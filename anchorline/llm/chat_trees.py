"""Reply trees to training conversations.

Root-to-leaf paths are found by pointer doubling: each self-join doubles the stretch of ancestors a node knows, so a
tree of depth d needs log2(d) joins. Branches are ranked before their paths are spelled out, and texts join last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.llm.store import stored

# The turn marks of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Make control strings inside a text harmless: afterwards ``<|`` occurs nowhere in it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """Roles end at a line break, so theirs are escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depth and score total of every node, and the jump table of each round.

    Round k knows the ancestor 2**k steps up and the score of the steps between. Only nodes that have not reached
    their root take part in the next join. A node whose parent is missing, null or itself is a root. Nodes on a cycle
    never reach a root and are left out.
    """
    climbing = F.when(~F.col("parent").eqNullSafe(F.col("node")), F.col("parent"))
    state = nodes.select("tree", "node", climbing.alias("up"), F.lit(1).alias("depth"), F.col("score").alias("total"))
    size, jumps, done, limit = nodes.count(), [], [], 1
    while limit <= 2 * size:
        done.append(state.filter(F.col("up").isNull()).select("tree", "node", "depth", "total"))
        going = state.filter(F.col("up").isNotNull())
        if not going.limit(1).count():
            break
        jumps.append(going.select("tree", "node", "up"))
        above = reduce(DataFrame.unionByName, [*(d.withColumn("up", F.lit(None).cast(state.schema["up"].dataType)) for d in done), going])
        above = above.select(
            "tree", F.col("node").alias("up"), F.col("up").alias("next"),
            F.col("depth").alias("more"), F.col("total").alias("plus"),
        )
        state = stored(
            going.join(above, ["tree", "up"], "left").select(
                "tree", "node", F.col("next").alias("up"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                (F.col("total") + F.coalesce("plus", F.lit(0.0))).alias("total"),
            ),
            "chat-jump",
        )
        limit *= 2
    return reduce(DataFrame.unionByName, done or [state.limit(0).select("tree", "node", "depth", "total")]), jumps


def branches(nodes: DataFrame, keep: int = 1) -> tuple[DataFrame, list[DataFrame]]:
    """The ``keep`` best root-to-leaf branches of each tree by mean node score, ties to the smaller leaf."""
    climbed, jumps = _climb(nodes)
    inner = nodes.filter(~F.col("parent").eqNullSafe(F.col("node"))).select("tree", F.col("parent").alias("node")).distinct()
    best = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("leaf"))
    ranked = (
        climbed.join(inner, ["tree", "node"], "left_anti")
        .select("tree", F.col("node").alias("leaf"), "depth", (F.col("total") / F.col("depth")).alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= keep)
    )
    return ranked, jumps


def paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """The nodes of the chosen branches: tree, leaf, rank, score, node, steps (turns up from the leaf).

    Walks the jump tables back, from single steps to the longest ones, and doubles what is known of each path.
    """
    chosen, jumps = branches(nodes, keep)
    walked = chosen.select("tree", "leaf", "rank", "score", F.col("leaf").alias("node"), F.lit(0).alias("steps"))
    for k, jump in enumerate(jumps):
        further = walked.join(jump, ["tree", "node"]).select(
            "tree", "leaf", "rank", "score", F.col("up").alias("node"), (F.col("steps") + (1 << k)).alias("steps")
        )
        walked = walked.unionByName(further)
        if k < len(jumps) - 1:
            walked = stored(walked, "chat-walk")
    return walked


def format_trees(nodes: DataFrame, keep: int = 1, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One conversation per chosen branch: tree, leaf, rank, score, formatted, loss.

    ``nodes`` holds tree, node, parent, role, text, score; (tree, node) is unique; other columns are ignored. Null
    roles and texts are empty, null scores zero. ``loss`` lists the (start, length) of each trained text in bytes of
    the formatted conversation; marks and roles are outside. No nodes give no rows.
    """
    nodes = nodes.select(
        "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    pieces = nodes.select(
        "tree", "node", head.alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*trained).alias("trained")
    )
    along = Window.partitionBy("tree", "leaf").orderBy(F.col("steps").desc())
    size = F.octet_length("head") + F.octet_length("body") + len(END) + 1
    return (
        paths(stored(nodes.select("tree", "node", "parent", "score"), "chat-nodes"), keep)
        .join(pieces, ["tree", "node"])
        .withColumn("to", F.sum(size.cast("long")).over(along))
        .withColumn("span", F.when(F.col("trained"), F.struct(
            (F.col("to") - len(END) - 1 - F.octet_length("body")).alias("start"), F.octet_length("body").alias("length")
        )))
        .groupBy("tree", "leaf")
        .agg(
            F.first("rank").alias("rank"), F.first("score").alias("score"),
            F.array_sort(F.collect_list(F.struct(
                (-F.col("steps")).alias("at"), F.concat("head", "body", F.lit(END + "\n")).alias("piece")
            ))).alias("turns"),
            F.array_sort(F.collect_list("span")).alias("loss"),
        )
        .select("tree", "leaf", "rank", "score", F.expr("array_join(transform(turns, t -> t.piece), '')").alias("formatted"), "loss")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the trained text of formatted conversations: tree, turns (role, text), loss_text."""
    return formatted.select(
        "*",
        F.expr(f"""transform(filter(split(formatted, '<[|]im_start[|]>'), (p, i) -> i > 0), p -> struct(
            substring_index(p, '\\n', 1) AS role,
            substring(p, length(substring_index(p, '\\n', 1)) + 2,
                      length(p) - length(substring_index(p, '\\n', 1)) - 2 - {len(END)}) AS text))""").alias("raw"),
    ).select(
        *formatted.columns,
        F.transform("raw", lambda t: F.struct(
            unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")
        )).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(
            F.encode("formatted", "utf-8"), s["start"].cast("int") + 1, s["length"]
        ).cast("string"))), "").alias("loss_text"),
    )


def chained(conversations: DataFrame) -> DataFrame:
    """Turn tables as reply trees of one branch: each turn answers the one before it.

    Rows of a conversation are ordered by turn, then role and text; equal rows each stay a turn. Null turns come
    first, a null conv_id is a conversation of its own. The tree is the conv_id as text after ``=``, or empty for null.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").withColumn(
        "node", F.row_number().over(order).cast("long")
    ).select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("tree"), "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.when(F.length(F.coalesce("text", F.lit(""))) > 0, 1.0).otherwise(0.0).alias("score"),
    )
