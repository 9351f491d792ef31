"""Benchmark decontamination over a positional inverted index of the training corpus.

The index holds one posting (term, row, position) for each training token whose term the benchmark uses. A window of
benchmark words is looked up through its two rarest terms: their posting lists are shifted by the terms' offsets in the
window and intersected, which leaves few alignments, and each of those is compared word by word with the document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.llm.store import stored

# Letters outside ASCII, digits and letters make words; only A-Z change case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASE = 10
# Rows of a side that may be broadcast: 16 bytes each in a term list. Larger ones are shuffled.
SMALL = 500_000


def lowered(word: Column) -> Column:
    """A-Z to lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words in their own case; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def row_key() -> Column:
    """What postings call a document. Rows with one key are looked at together, and compared on their own texts."""
    return F.xxhash64("doc_id", "text")


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast a stored table if its row count allows it."""
    return F.broadcast(df) if df.count() <= SMALL else df


@dataclass(frozen=True)
class Index:
    """postings: term, row, pos; terms: term, n (how often it occurs)."""

    postings: DataFrame
    terms: DataFrame


def build(docs: DataFrame, items: DataFrame | None = None) -> Index:
    """Index the whole texts of doc_id, text; with ``items`` only the terms that they use."""
    tokens = docs.select(row_key().alias("row"), F.posexplode(words_of(F.col("text"))).alias("pos", "word")).select(
        F.xxhash64(lowered(F.col("word"))).alias("term"), "row", "pos"
    )
    if items is not None:
        used = items.select(F.explode(words_of(F.col("text"))).alias("word")).select(
            F.xxhash64(lowered(F.col("word"))).alias("term")
        ).distinct()
        tokens = tokens.join(small_side(stored(used, "phrase-terms")), "term", "left_semi")
    postings = stored(tokens, "phrase-postings")
    return Index(postings, stored(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "phrase-counts"))


def windows_of(items: DataFrame, size: int = PHRASE) -> DataFrame:
    """The distinct items with a word: item (id as text, empty for null), key, words, size of their windows."""
    worded = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.transform(words_of(F.col("text")), lowered).alias("words"),
    ).filter(F.size("words") > 0).distinct()
    return worded.withColumn("key", F.xxhash64("item", "words")).withColumn("size", F.least(F.lit(size), F.size("words")))


def anchors(index: Index, windows: DataFrame) -> DataFrame:
    """The two rarest places of every window, one row per different choice.

    key, first and second (term, offset in the item), starts (the windows that chose them). A window with a term that
    the corpus lacks occurs nowhere and is left out.
    """
    placed = windows.select("key", "size", F.size("words").alias("length"), F.posexplode("words").alias("at", "word")).select(
        "key", "size", "length", "at", F.xxhash64("word").alias("term")
    ).join(index.terms, "term", "left")
    spread = placed.select(
        "key", "size", "term", "at", F.coalesce("n", F.lit(0)).alias("n"),
        F.explode(F.sequence(
            F.greatest(F.lit(0), F.col("at") - F.col("size") + 1), F.least(F.col("at"), F.col("length") - F.col("size"))
        )).alias("start"),
    )
    rarest = Window.partitionBy("key", "start").orderBy("n", "at")
    return (
        spread.withColumn("rank", F.row_number().over(rarest))
        .filter(F.col("rank") <= 2)
        .groupBy("key", "start")
        .agg(F.min("n").alias("least"), F.min(F.struct("rank", "term", "at")).alias("first"),
             F.max(F.struct("rank", "term", "at")).alias("second"))
        .filter(F.col("least") > 0)
        .groupBy("key", "first.term", "first.at", F.col("second.term").alias("term2"), F.col("second.at").alias("at2"))
        .agg(F.sort_array(F.collect_set("start")).alias("starts"))
    )


def alignments(index: Index, windows: DataFrame) -> DataFrame:
    """Where both rarest terms of a window stand as they do in it: row, key, shift, starts (of windows to compare)."""
    chosen = stored(anchors(index, windows), "phrase-anchors")
    seconds = stored(chosen.select(F.col("term2").alias("term")).distinct(), "phrase-seconds")
    shifted = index.postings.join(small_side(chosen), "term").select(
        "row", "key", (F.col("pos") - F.col("at")).alias("shift"), "term2", "at2", "starts"
    ).withColumn("pos2", F.col("shift") + F.col("at2"))
    others = index.postings.join(small_side(seconds), "term", "left_semi").select(
        F.col("term").alias("term2"), "row", F.col("pos").alias("pos2")
    )
    return shifted.join(others, ["term2", "row", "pos2"], "left_semi").groupBy("row", "key", "shift").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("starts")))).alias("starts")
    )


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = PHRASE) -> DataFrame:
    """Exact occurrences of item windows: all columns of ``docs`` plus ``__words`` (count) and ``__hits``.

    ``__hits`` is the sorted array of (start, stop, item), word positions of each occurrence, empty where there is
    none. Items shorter than ``size`` words are one window; items or documents without words match nothing. Null
    texts have no words; equal rows stay and match alike.
    """
    windows = stored(windows_of(items, size), "phrase-windows")
    found = alignments(build(docs, items), windows).join(small_side(windows), "key")
    per_row = found.groupBy(F.col("row").alias("__row")).agg(
        F.collect_list(F.struct("shift", "starts", "item", "words", "size")).alias("__found")
    )
    lower = "CASE WHEN octet_length(w) = length(w) THEN lower(w) ELSE translate(w, '{0}', '{1}') END".format(UPPER, LOWER)
    hits = f"""array_sort(flatten(transform(__found, c -> transform(
        filter(c.starts, s -> c.shift + s >= 0 AND
            transform(slice(__texts, greatest(c.shift + s, 0) + 1, c.size), w -> {lower}) = slice(c.words, s + 1, c.size)),
        s -> struct(c.shift + s AS start, c.shift + s + c.size AS stop, c.item AS item)))))"""
    empty = "CAST(array() AS ARRAY<STRUCT<start: INT, stop: INT, item: STRING>>)"
    return (
        docs.withColumn("__row", row_key())
        .join(per_row, "__row", "left")
        .withColumn("__texts", words_of(F.col("text")))
        .withColumn("__words", F.size("__texts").cast("long"))
        .withColumn("__hits", F.expr(f"CASE WHEN __found IS NULL THEN {empty} ELSE {hits} END"))
        .select(*docs.columns, "__words", "__hits")
    )


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 20, size: int = PHRASE) -> DataFrame:
    """Documents where the two rarest terms of a window stand at most ``slop`` words apart, in any order.

    row (see ``row_key``), item, near (least distance). Positions are paired through stretches of ``slop`` words, a
    place with its own stretch and both neighbours, so no document's postings meet as a whole.
    """
    windows = stored(windows_of(items, size), "phrase-windows")
    index = build(docs, items)
    chosen = stored(anchors(index, windows).select("key", "term", "term2", (F.col("at") == F.col("at2")).alias("single")).distinct(), "phrase-pairs")
    left = index.postings.join(small_side(chosen), "term").select(
        "row", "key", "term2", "pos", "single", F.explode(F.array(*[F.floor(F.col("pos") / slop) + d for d in (-1, 0, 1)])).alias("stretch")
    )
    seconds = stored(chosen.select(F.col("term2").alias("term")).distinct(), "phrase-seconds")
    right = index.postings.join(small_side(seconds), "term", "left_semi").select(
        F.col("term").alias("term2"), "row", F.col("pos").alias("pos2"), F.floor(F.col("pos") / slop).alias("stretch")
    )
    apart = F.abs(F.col("pos") - F.col("pos2"))
    return (
        left.join(right, ["term2", "row", "stretch"])
        .filter((apart <= slop) & ((apart > 0) | F.col("single")))
        .groupBy("row", "key").agg(F.min(apart).alias("near"))
        .join(small_side(windows), "key").select("row", "item", "near")
    )


def proximity(docs: DataFrame, items: DataFrame, slop: int = 20, size: int = PHRASE) -> DataFrame:
    """All columns of ``docs`` plus ``near``: sorted item (id as text) and least distance, empty where there is none."""
    per_row = (
        proximity_matches(docs, items, slop, size)
        .groupBy(F.col("row").alias("__row"), "item").agg(F.min("near").alias("near"))
        .groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("item", "near"))).alias("__near"))
    )
    return (
        docs.withColumn("__row", row_key()).join(per_row, "__row", "left")
        .withColumn("near", F.coalesce("__near", F.expr("CAST(array() AS ARRAY<STRUCT<item: STRING, near: INT>>)")))
        .select(*[c for c in docs.columns if c != "near"], "near")
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = PHRASE) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit (words inside an occurrence), items (sorted ids, as text).

    Columns of ``docs`` with these names are replaced.
    """
    covered = """aggregate(__hits, struct(0 AS last, 0L AS n),
        (a, h) -> struct(greatest(a.last, h.stop) AS last, a.n + greatest(0, h.stop - greatest(a.last, h.start)) AS n), a -> a.n)"""
    return (
        phrase_matches(docs, items, size)
        .withColumn("n_words", F.col("__words"))
        .withColumn("n_hit", F.expr(covered))
        .withColumn("items", F.expr("array_sort(array_distinct(transform(__hits, h -> h.item)))"))
        .drop("__words", "__hits")
    )
