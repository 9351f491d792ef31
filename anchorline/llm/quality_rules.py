"""Quality rules kept as a ledger of failure bits, judged later by versioned policies.

Every rule is evaluated once per document. The ledger holds the measurements and one bit per failed rule; a policy is
a set of bits that reject, so another version, or a policy without one rule, needs no second look at the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# What is a word, and what is a symbol.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A named rule; its bit never changes once ledgers are stored."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(5, "capitals", "2 * n_upper > word_chars"),
)

BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "capitals"),
    "v2": (*BASE, "symbols", "capitals", "repeated_lines", "word_length"),
}


def mask_of(names: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in set(names))


def _repeated(words: str, hashes: str, windows: str) -> Column:
    """Words inside windows that occur more than once.

    Documents whose window hashes are all different are done at once. In the others the windows are sorted by 128 bits
    of hash, those equal to a neighbour are kept, and the union of their extents is summed in order of position.
    """
    return F.expr(f"""
        CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE
        aggregate(
          array_sort(transform(array(array_sort(transform({windows},
              (h, i) -> struct(h, xxhash64(slice({words}, i + 1, {WINDOW})) AS g, i)))),
            s -> transform(filter(s, (x, j) ->
                  (get(s, j - 1).h <=> x.h AND get(s, j - 1).g <=> x.g)
                  OR (get(s, j + 1).h <=> x.h AND get(s, j + 1).g <=> x.g)), x -> x.i))[0]),
          struct(-{WINDOW} AS last, 0L AS n),
          (a, p) -> struct(p AS last, a.n + least({WINDOW}, p - a.last) AS n),
          a -> a.n) END""")


def ledger(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, the measurements, and ``failed``, the bits of the failed rules.

    Needs the columns doc_id and text; others are ignored. A null text counts as empty, which has no words and fails
    ``few_words``. Repeated rows are measured each on their own, in any order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = "filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    measured = (
        docs.select("doc_id", text.alias("text"))
        .select(
            "doc_id", "text",
            F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
            F.expr(lines).alias("lines"),
        )
        .withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
        .withColumn("windows", F.expr(
            f"CASE WHEN size(hashes) < {WINDOW} THEN CAST(array() AS ARRAY<BIGINT>) ELSE "
            f"transform(sequence(1, size(hashes) - {WINDOW - 1}), i -> xxhash64(slice(hashes, i, {WINDOW}))) END"
        ))
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.regexp_replace("text", SYMBOL, ""))).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
            _repeated("words", "hashes", "windows").alias("n_repeat_words"),
        )
    )
    failed = F.lit(0).cast("long")
    for rule in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(0).cast("long"))
    return measured.withColumn("failed", failed)


def judge(rows: DataFrame, policy: str) -> DataFrame:
    """Add the verdict of a policy to a ledger.

    ``rejected_by`` holds the bits that count under the policy, ``kept`` is true where there are none, and
    ``sole_rule`` names the rule without which the document would stay.
    """
    hit = F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long"))
    names = F.create_map(*[F.lit(v) for r in RULES for v in (1 << r.bit, r.name)])
    return (
        rows.withColumn("rejected_by", hit)
        .withColumn("kept", F.col("rejected_by") == 0)
        .withColumn("sole_rule", F.when(
            F.bit_count("rejected_by") == 1, F.try_element_at(names, F.col("rejected_by").cast("int"))
        ))
    )


def judge_all(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Add the verdicts of several policies to a ledger: ``kept_`` and ``sole_rule_`` with the name of each."""
    for policy in policies:
        judged = judge(rows, policy)
        rows = judged.withColumnsRenamed({"kept": f"kept_{policy}", "sole_rule": f"sole_rule_{policy}"}).drop("rejected_by")
    return rows


def ablations(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Per policy and rule: documents, failures, rejections with and without the rule.

    The ledger is first reduced to one row per set of bits, at most two to the number of rules, and everything else
    is bit arithmetic on those. An empty ledger gives an empty table.
    """
    patterns = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    spark = rows.sparkSession
    grid = spark.createDataFrame(
        [(p, r.name, 1 << r.bit, mask_of(POLICIES[p])) for p in policies for r in RULES if r.name in POLICIES[p]],
        "policy STRING, rule STRING, bit BIGINT, mask BIGINT",
    )
    # A handful of constant rows against a bounded number of patterns.
    paired = patterns.withColumn("one", F.lit(1)).join(F.broadcast(grid.withColumn("one", F.lit(1))), "one")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    inside = F.col("failed").bitwiseAND(F.col("mask"))
    return paired.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        count(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(inside != 0).alias("n_rejected"),
        count(inside.bitwiseAND(F.bitwise_not(F.col("bit"))) != 0).alias("n_rejected_without"),
        count(inside == F.col("bit")).alias("n_only_this"),
    )
