"""Spelling variants through a trie whose edges are a table and whose frontier is a join.

Words of one length share a trie, once spelled forwards and once backwards. Each trie begins at the words' middles, so
an edit in the second half of a word is found forwards and one in the first half backwards, and the frontier never
branches near the root. Nodes are the places where words part; an edge carries the letters up to the next such place. A
state is (word, position, node, edits): it joins the edge table by its node and next letter, level by level, and a state
that reaches the end of a word with one edit has found a neighbour.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.store import stored

# Fixed value: letters that make words.
RUN = "[A-Za-zÀ-ÿ]"
LEAST = 7
# Different words a task counts before it hands them on.
COUNTED = 300_000


def lowered(run: str) -> str:
    """A-Z to lower case, other letters as they are."""
    return run.lower() if run.isascii() else "".join(c.lower() if c < "\x80" else c for c in run)


def slipped(doc_id: str, run: str) -> str:
    """The run, or the run without one letter where the checksum of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, change=None, least: int = LEAST, seen: int = 2) -> DataFrame:
    """word, n: the maximal runs of letters of whole texts, lower-cased, that have ``least`` letters and occur ``seen`` times.

    ``change`` (doc_id as text, run) may put another word in a run's place, the same for equal runs of a document; it
    must not make a run longer. A null text has no runs; a null doc_id counts as an empty text; repeated rows count
    again. Runs are counted within each task before they are shuffled.
    """
    # A run that may end up long enough is at least as long itself, and a match of so many letters takes the whole run.
    pattern = f"{RUN}{{{least},}}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = regex.compile(pattern).findall, Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for found, n in Counter(find(text.as_py() or "")).items():
                    word = lowered(found)
                    if change is not None:
                        word = change(doc_id or "", word)
                    if len(word) >= least:
                        counts[word] += n
                if len(counts) >= COUNTED:
                    yield flush()
        yield flush()

    parts = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word STRING, n BIGINT")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= seen)


def _starts(length: int) -> tuple[int, int]:
    """Where the tries of a length begin, forwards and backwards: together they see an edit at any place."""
    return length // 2, length - length // 2


def _nodes(side: int, length: int, word: str, start: int, stop: int) -> list[bytes]:
    """Names of the prefixes of ``start`` to ``stop`` - 1 letters: 128 bits of side, length and letters."""
    digest = blake2b(f"{side}:{length}:{word[:start]}".encode(), digest_size=16)
    names = [digest.digest()]
    for letter in word[start : stop - 1]:
        digest.update(letter.encode())
        names.append(digest.copy().digest())
    return names


def spelled(words: DataFrame) -> DataFrame:
    """side, word (as spelled on that side), n, start, nodes (of every prefix from start on), shorter (root of the trie one letter shorter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                rows: list[tuple] = []
                batch = whole.slice(at, 1000)
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    size = len(word)
                    for side, spelling in enumerate((word, word[::-1])):
                        start, shorter = _starts(size)[side], _starts(size - 1)[side]
                        rows.append((side, spelling, n, start, _nodes(side, size, spelling, start, size),
                                     _nodes(side, size - 1, spelling, shorter, shorter)[0], shorter))
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 ["side", "word", "n", "start", "nodes", "shorter", "shorter_start"])

    schema = "side INT, word STRING, n BIGINT, start INT, nodes ARRAY<BINARY>, shorter BINARY, shorter_start INT"
    return stored(words.select("word", "n").mapInArrow(run, schema), "spelling-words")


def _letters(word: str, at: str, size: str = "1") -> str:
    """SQL of letters from place ``at`` (from 0)."""
    return f"substring({word}, CAST({at} + 1 AS INT), CAST({size} AS INT))"


def paths(words: DataFrame) -> DataFrame:
    """side, word, n, places: the nodes of a word's path where other words of its length part from it, and its root.

    ``places`` is sorted: at (letters before the node), node.
    """
    steps = words.select("side", "word", "n", "start", F.posexplode("nodes").alias("i", "node")).select(
        "side", "word", "n", (F.col("start") + F.col("i")).alias("at"), "node", "i"
    ).withColumn("letter", F.expr(_letters("word", "at")))
    inner = steps.filter("i > 0")
    forks = inner.groupBy("node").agg(F.min("letter").alias("a"), F.max("letter").alias("b")).filter("a <> b").select("node")
    met = inner.join(forks, "node", "left_semi").select("side", "word", "at", "node").groupBy("side", "word").agg(
        F.collect_list(F.struct("at", "node")).alias("more")
    )
    root = F.array(F.struct(F.col("start").alias("at"), F.col("nodes")[0].alias("node")))
    return stored(
        words.join(met, ["side", "word"], "left").select(
            "side", "word", "n",
            F.when(F.col("more").isNull(), root).otherwise(F.concat(root, F.array_sort("more"))).alias("places"),
        ), "spelling-paths",
    )


def edges(found: DataFrame) -> DataFrame:
    """node, letter, label (letters up to the next node, the first is ``letter``), child (null at a word's end), n (of that word)."""
    listed = found.select("word", "n", "places", F.posexplode("places").alias("i", "p")).select(
        "p.node", "word", "n", "p.at", F.expr("get(places, i + 1)").alias("next")
    )
    return stored(
        listed.select(
            "node", F.expr(_letters("word", "at", "coalesce(next.at, length(word)) - at")).alias("label"),
            F.col("next.node").alias("child"), F.when(F.col("next").isNull(), F.col("n")).alias("n"),
        ).distinct().withColumn("letter", F.substring("label", 1, 1)), "spelling-edges",
    )


def replaced(found: DataFrame, table: DataFrame) -> DataFrame:
    """First states of replaced letters: at a node of its own path a word takes an edge with a later letter.

    The pair is found from the word whose letter comes first, so each pair once. ``target`` is the word looked for.
    """
    here = found.select("side", "word", "n", F.explode("places").alias("p")).select("side", "word", "n", "p.at", "p.node").withColumn(
        "own", F.expr(_letters("word", "at"))
    )
    agree = F.expr(f"substring(label, 2) = {_letters('word', 'at + 1', 'length(label) - 1')}")
    return here.join(table.withColumnRenamed("n", "target_n"), "node").filter((F.col("letter") > F.col("own")) & agree).select(
        "side", "word", "n", F.expr(f"concat({_letters('word', '0', 'at')}, label, substring(word, CAST(at + length(label) + 1 AS INT)))").alias("target"),
        (F.col("at") + F.length("label")).alias("at"), F.col("child").alias("node"), "target_n",
    )


def deleted(words: DataFrame, least: int) -> DataFrame:
    """First states of deleted letters: every word at the root of the trie of the next shorter words, no edit made yet."""
    return words.filter(F.length("word") > least).select(
        "side", "word", "n", F.lit(None).cast("string").alias("target"), F.col("shorter_start").alias("at"),
        F.col("shorter").alias("node"), F.lit(None).cast("long").alias("target_n"),
    )


def advance(states: DataFrame, table: DataFrame) -> DataFrame:
    """One level: every state takes the edges that agree with its word.

    A state whose edit is made follows the letters of its target. One without an edit follows its word while an edge
    agrees as a whole; else the edge must be the word's letters without one of them, and the edit is made there. A
    deletion at the node itself needs the next letter but one, so such a state asks for two letters.
    """
    text = "coalesce(target, word)"
    asked = states.withColumn("letter", F.explode(F.expr(
        f"IF(target IS NULL, array_distinct(array({_letters('word', 'at')}, {_letters('word', 'at + 1')})), array({_letters(text, 'at')}))"
    )))
    met = asked.drop("target_n").join(table.withColumnRenamed("node", "parent").withColumnRenamed("n", "target_n").withColumnRenamed("letter", "first"),
                     (F.col("node") == F.col("parent")) & (F.col("letter") == F.col("first")))
    size = "length(label)"
    same = F.expr(f"label = {_letters(text, 'at', size)}")
    without = F.expr(f"levenshtein(label, {_letters('word', 'at', size + ' + 1')}, 1) = 1 AND length(word) > at + {size}")
    target = F.expr(f"concat({_letters('word', '0', 'at')}, label, substring(word, CAST(at + {size} + 2 AS INT)))")
    # The end of the shorter word is reached without an edit: the word's last letter is the one too many.
    after = (
        F.when(F.col("target").isNotNull(), F.col("target"))
        .when(same & F.col("child").isNull(), F.expr(f"{_letters('word', '0', 'at')} || label"))
        .when(~same, target)
    )
    return met.filter(same | (F.col("target").isNull() & without)).select(
        "side", "word", "n", after.alias("target"), (F.col("at") + F.length("label")).alias("at"), F.col("child").alias("node"), "target_n"
    )


def near_pairs(words: DataFrame, least: int = LEAST) -> DataFrame:
    """word, n, other, other_n for every two words one inserted, deleted or replaced letter apart, each pair both ways.

    ``words`` (word, n) has different words of at least ``least`` (2 or more) letters. Takes as many rounds as there are
    nodes on a path, whatever the length of the words. Nothing is cut off: a node that many words pass is one row of
    each of them, and a state joins at most one edge for each letter it asks for.
    """
    told = spelled(words)
    found = paths(told)
    table = edges(found)
    reached = stored(replaced(found, table), "spelling-states")
    finished = [reached.filter("node IS NULL")]
    states = reached.filter("node IS NOT NULL").unionByName(deleted(told, least))
    while True:
        reached = stored(advance(states, table), "spelling-states")
        finished.append(reached.filter("node IS NULL"))
        states = reached.filter("node IS NOT NULL")
        if states.isEmpty():
            break
    ends = finished[0]
    for more in finished[1:]:
        ends = ends.unionByName(more)
    forward = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))
    # The two sides overlap in the middle, so a pair may come twice.
    pairs = ends.select(forward("word").alias("word"), "n", forward("target").alias("other"), F.col("target_n").alias("other_n")).distinct()
    both = F.explode(F.array(
        F.struct("word", "n", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    ))
    return pairs.select(both.alias("p")).select("p.*")


def variants(words: DataFrame, ratio: int = 10, least: int = LEAST) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of ``words`` (word, n; different words).

    n_near counts the words one edit apart. form is the most frequent of them (ties: the smallest in code-point order)
    if it is at least ``ratio`` (2 or more) times as frequent as the word, else null; form_n is its n. root is where
    forms lead in the end, the word itself without one. An empty table gives an empty result.
    """
    if ratio < 2 or least < 2:
        raise ValueError("ratio and least must be at least 2")
    words = stored(words.select("word", "n"), "spelling-counts")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other")))
    near = near_pairs(words, least).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    form = F.when(-F.col("b.m") >= ratio * F.col("n"), F.col("b.other"))
    told = stored(
        words.join(near, "word", "left").select(
            "word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(form.isNotNull(), -F.col("b.m")).alias("form_n"),
        ), "spelling-forms",
    )
    return told.join(_roots(told.filter("form IS NOT NULL").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: pointers are doubled until none moves. Each step is more frequent, so paths are short and end."""
    state = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        state = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return state
