"""Line deduplication by an edit-distance join.

Two lines within distance k must agree on one of any k + 1 segments of the shorter. So every distinct line is indexed
by its k + 1 segments and probes the indexes of the lengths just below its own with the few substrings that can align.
Pairs that meet are checked by a banded bit-parallel comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.llm.phrase_index import row_key, small_side
from anchorline.llm.store import stored

WORDED = r"[^\x20\x09-\x0D]"


# Letters whose counts are compared, and the bits of each count. Any letters would do; frequent ones tell most.
COUNTED = "enthaori"
BITS = 5
# Lines are looked at one in SHARE for keys that many share; SEEN of them make a key crowded.
SHARE, SEEN = 64, 4
# Lines of a crowded key that meet as many others in one row.
BLOCK = 256
# The least length at which two edits change at most a quarter of a line. Of shorter ones most near pairs are chance.
SHORT = 8


def _segment(length: str, i: int, parts: int) -> tuple[str, str]:
    """Start (from 0) and size of segment i of an even split; the last segments take what is left over."""
    base, extra = f"({length} DIV {parts})", f"({length} % {parts})"
    return f"({i} * {base} + greatest(0, {i - parts} + {extra}))", f"({base} + IF({i - parts} + {extra} >= 0, 1, 0))"


def _key(length: str, i: int, start: str, size: str) -> str:
    return f"xxhash64({length}, {i}, substring(line, CAST({start} + 1 AS INT), CAST({size} AS INT)))"


def index_keys(k: int) -> Column:
    """The k + 1 segments of column ``line`` of column ``size`` characters, as hashes with length and number."""
    return F.expr("array(" + ", ".join(_key("size", i, *_segment("size", i, k + 1)) for i in range(k + 1)) + ")")


def probe_keys(k: int, shortest: int) -> Column:
    """The substrings of ``line`` that can equal a segment of a line 0 to k characters shorter.

    Segment i can shift by at most i places counted from the left and, from the right, by k - i places around the
    difference d of the lengths; only starts within both limits are probed.
    """
    lengths = []
    for d in range(k + 1):
        keys = []
        for i in range(k + 1):
            start, size = _segment(f"(size - {d})", i, k + 1)
            keys += [_key(f"(size - {d})", i, f"{start} + {p}", size) for p in range(max(-i, d - k + i), min(i, d + k - i) + 1)]
        lengths.append(f"IF(size - {d} >= {shortest}, array({', '.join(keys)}), CAST(array() AS ARRAY<BIGINT>))")
    return F.expr(f"concat({', '.join(lengths)})")


def letter_counts() -> Column:
    """How often each counted letter occurs in ``line``, as BITS low bits each of one number."""
    parts = [
        f"shiftleft(CAST((octet_length(line) - octet_length(replace(line, '{c}', ''))) & {(1 << BITS) - 1} AS BIGINT), {BITS * n})"
        for n, c in enumerate(COUNTED)
    ]
    return F.expr(" | ".join(parts))


def counts_apart(a: str, b: str) -> str:
    """SQL of a lower bound of the sum of the differences of the letter counts."""
    full = 1 << BITS
    one = lambda n: f"((shiftright({a}, {BITS * n}) - shiftright({b}, {BITS * n})) & {full - 1})"
    return " + ".join(f"least({one(n)}, {full} - {one(n)})" for n in range(len(COUNTED)))


def ahead(size_a: str, a: str, size_b: str, b: str) -> str:
    """SQL of the order in which two lines meet: the shorter is indexed, the other probes; of one length, by hash."""
    return f"({size_b} > {size_a} OR ({size_b} = {size_a} AND {b} > {a}))"


def distance_within(a: str, b: str, k: int) -> str:
    """SQL of the edit distance of two text columns where it is at most ``k`` (a few), else null.

    Bit d of state e says that the characters of a so far and as many of b, plus d - k, are at most e edits apart. One
    step per character moves all diagonals of the band at once: a match keeps a diagonal, an edit enters it from the
    state before or from beside. Once no diagonal is left, the rest is passed over.
    """
    band = (1 << (2 * k + 1)) - 1
    agree = " + ".join(f"IF(get(y, s.at + {d - k}) = c, {1 << d}, 0)" for d in range(2 * k + 1))
    steps = ["((s.r0 & m))"]
    for e in range(1, k + 1):
        steps.append(f"((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | shiftleft({steps[-1]}, 1)) & {band}")
    first = ", ".join(f"{sum(1 << (k + d) for d in range(e + 1))} AS r{e}" for e in range(k + 1))
    after = ", ".join(f"{s} AS r{e}" for e, s in enumerate(steps))
    told = " ".join(f"WHEN shiftright(s.r{e}, size(y) - size(x) + {k}) & 1 = 1 THEN {e}" for e in range(k + 1))
    return f"""transform(array(struct(regexp_extract_all({a}, '(?s).', 0) AS x, regexp_extract_all({b}, '(?s).', 0) AS y)),
        t -> transform(array(t.x), x -> transform(array(t.y), y -> IF(abs(size(y) - size(x)) > {k}, NULL,
            aggregate(x, struct(0 AS at, {first}),
                (s, c) -> IF(s.r{k} = 0, s, transform(array({agree}), m -> struct(s.at + 1 AS at, {after}))[0]),
                s -> CASE {told} END)))[0])[0])[0]"""


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row, line_no (from 0), line for each line with a character that is not white space."""
    return docs.select(
        "doc_id", row_key().alias("row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")
    ).filter(F.col("line").rlike(WORDED))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """One row per different line: g, h (128 bits of hash), first (doc_id, row, line_no), copies, line, size, counts."""
    return (
        lines_of(docs)
        .groupBy(F.xxhash64("line").alias("h"), F.xxhash64(F.lit("again"), "line").alias("g"))
        .agg(F.min(F.struct("doc_id", "row", "line_no", "line")).alias("f"), F.count(F.lit(1)).alias("copies"))
        .select("h", "g", F.struct("f.doc_id", "f.row", "f.line_no").alias("first"), "copies",
                F.col("f.line").alias("line"), F.length("f.line").alias("size"))
        .withColumn("counts", letter_counts())
    )


def crowded_keys(long: DataFrame, k: int, least: int) -> DataFrame:
    """Keys that many lines share, found in a part of the lines that their hash draws.

    Which keys these are decides how pairs are counted, never which pairs. One in SHARE lines is looked at, so the table
    is small against the lines.
    """
    part = long.filter(F.pmod("h", F.lit(SHARE)) == 0)
    keys = part.select(F.explode(F.concat(index_keys(k), probe_keys(k, least))).alias("key"))
    return stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN).select(F.col("key").alias("crowd")), "edit-crowds")


def meetings(long: DataFrame, crowds: DataFrame, k: int, least: int) -> DataFrame:
    """What the keys bring together, written down: a and b (hashes of lines), each pair once, and members of crowds.

    A line with a crowded key does not meet the other lines of that key here but one mark of it, so it comes out alone:
    as a with the key in ``crowd`` if it is indexed under it, as b if it probes it.
    """
    def side(keys: Column, name: str, role: int, key: str) -> DataFrame:
        rows = long.select(
            F.explode(keys).alias("own"), F.col("h").alias(name), F.col("size").alias(f"size_{name}"), F.col("counts").alias(f"counts_{name}")
        ).join(small_side(crowds), F.col("own") == F.col("crowd"), "left")
        dealt = F.when(F.col("crowd").isNull(), F.col("own")).otherwise(F.xxhash64("own", F.lit(role)))
        found = rows.select(dealt.alias(key), name, f"size_{name}", f"counts_{name}", F.col("crowd").alias(f"crowd_{name}"))
        # The marks that the other side's members meet.
        marks = crowds.select(F.xxhash64("crowd", F.lit(1 - role)).alias(key))
        return found.unionByName(marks, allowMissingColumns=True)

    left, right = side(index_keys(k), "a", 0, "key"), side(probe_keys(k, least), "b", 1, "probe")
    met = F.expr(
        f"key = probe AND (a IS NULL OR b IS NULL OR (crowd_a IS NULL AND crowd_b IS NULL AND {counts_apart('counts_a', 'counts_b')} <= {2 * k} "
        f"AND {ahead('size_a', 'a', 'size_b', 'b')}))"
    )
    return stored(left.join(right, met).select("a", "b", F.coalesce("crowd_a", "crowd_b").alias("crowd")).distinct(), "edit-meetings")


def neighbours(lines: DataFrame, k: int = 2, shortest: int = 30) -> DataFrame:
    """h, g, n_links, other (the least first place) of each line with different lines at most ``k`` edits away.

    Lines under ``shortest`` characters (at least k + 1) have no links. ``lines`` is the table of ``distinct_lines``,
    written down. Pairs that meet under a key of few lines are listed, each once; under keys that many lines share they
    are counted in blocks, so that no row is made for each pair. Both thin pairs without loss by their letter counts: an
    edit changes the sum of their differences by at most two.
    """
    least = max(shortest, k + 1)
    long = lines.filter(F.col("size") >= least)
    crowds = crowded_keys(long, k, least)
    met = meetings(long, crowds, k, least)
    members = _members(lines, met)
    return (
        _told(listed_links(lines, met.filter("crowd IS NULL").select("a", "b"), members, k)).unionByName(block_links(members, k))
        .groupBy("h", "g").agg(F.sum("n_links").alias("n_links"), F.min("other").alias("other"))
    )


def _told(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("left").alias("me"), F.col("right.first").alias("other")).unionByName(
        pairs.select(F.col("right").alias("me"), F.col("left.first").alias("other"))
    )
    return both.groupBy(F.col("me.h").alias("h"), F.col("me.g").alias("g")).agg(F.count(F.lit(1)).alias("n_links"), F.min("other").alias("other"))


def listed_links(lines: DataFrame, pairs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Pairs of different lines at most ``k`` edits apart: left and right (h, g, first), distance; each pair once.

    Leaves out pairs that share a crowded key, which are counted in blocks.
    """
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "edit-ends")
    texts = lines.join(small_side(ends), "h", "left_semi").select("h", "g", "first", "line")
    texts = stored(texts.join(small_side(members.select("h", "g", "indexed", "probed")), ["h", "g"], "left"), "edit-texts")
    named = lambda name, line, keys: texts.select(
        F.col("h").alias(name), F.struct("h", "g", "first").alias(f"{name}_of"), F.col("line").alias(line), F.col(keys).alias(f"{name}_crowds")
    )
    found = pairs.join(named("a", "x_line", "indexed"), "a").join(named("b", "y_line", "probed"), "b")
    return found.filter(~F.coalesce(F.arrays_overlap("a_crowds", "b_crowds"), F.lit(False))).select(
        F.col("a_of").alias("left"), F.col("b_of").alias("right"), F.expr(distance_within("x_line", "y_line", k)).alias("distance")
    ).filter(F.col("distance").isNotNull())


def _members(lines: DataFrame, met: DataFrame) -> DataFrame:
    """The lines that have a crowded key, with those keys: indexed, probed."""
    keys = met.filter("crowd IS NOT NULL").groupBy(F.coalesce("a", "b").alias("h")).agg(
        F.sort_array(F.collect_set(F.when(F.col("a").isNotNull(), F.col("crowd")))).alias("indexed"),
        F.sort_array(F.collect_set(F.when(F.col("b").isNotNull(), F.col("crowd")))).alias("probed"),
    )
    named = lines.join(small_side(stored(keys, "edit-crowd-keys")), "h")
    return stored(named.select("h", "g", "first", "line", "size", "counts", "indexed", "probed"), "edit-members")


def block_links(members: DataFrame, k: int) -> DataFrame:
    """h, g, n_links, other for pairs under crowded keys, counted in blocks of BLOCK by BLOCK lines.

    A key's lines are dealt into blocks by their hash; each block of indexed lines meets each block of probing ones in one
    row, which gives one number a line. A pair counts under the least of the crowded keys it shares.
    """
    told = "h, g, first, line, size, counts, indexed, probed"

    def dealt(keys: str, name: str) -> DataFrame:
        rows = members.select(F.explode(keys).alias("key"), F.struct(*told.split(", ")).alias("m"))
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        block = F.expr(f"pmod(xxhash64(m.h, m.g), ceil(n / {float(BLOCK)}))")
        return rows.join(small_side(stored(sizes, "edit-sizes")), "key").groupBy("key", block.alias(f"block_{name}")).agg(F.collect_list("m").alias(name))

    met = stored(dealt("indexed", "xs"), "edit-blocks").join(
        stored(dealt("probed", "ys").withColumnRenamed("key", "probe"), "edit-blocks"), F.col("key") == F.col("probe")
    )
    near = (
        f"{ahead('p.size', 'p.h', 'q.size', 'q.h')} AND {counts_apart('p.counts', 'q.counts')} <= {2 * k} "
        f"AND array_intersect(p.indexed, q.probed)[0] = key AND {distance_within('p.line', 'q.line', k)} IS NOT NULL"
    )
    # One matrix of near pairs a row; both sides read it.
    counted = f"""transform(array(transform(xs, p -> transform(ys, q -> coalesce({near}, false)))), m -> concat(
        transform(xs, (p, i) -> struct(p.h AS h, p.g AS g, size(filter(m[i], v -> v)) AS n,
            array_min(transform(filter(ys, (q, j) -> m[i][j]), q -> q.first)) AS other)),
        transform(ys, (q, j) -> struct(q.h AS h, q.g AS g, size(filter(m, row -> row[j])) AS n,
            array_min(transform(filter(xs, (p, i) -> m[i][j]), p -> p.first)) AS other))))[0]"""
    found = met.select(F.explode(F.filter(F.expr(counted), lambda r: r["n"] > 0)).alias("r")).select("r.*")
    return found.groupBy("h", "g").agg(F.sum("n").alias("n_links"), F.min("other").alias("other"))


def classes(docs: DataFrame, k: int = 2, shortest: int = 30) -> DataFrame:
    """What is known of each line that has copies or links: h, g, keeper, n_links (to different lines).

    The keeper is the earliest of the line's own occurrences and the first occurrences of the lines it is linked to.
    """
    lines = stored(distinct_lines(docs), "edit-lines")
    linked = stored(neighbours(lines, k, shortest), "edit-links")
    return (
        lines.select("h", "g", "first", "copies").join(linked, ["h", "g"], "left")
        .filter((F.col("copies") > 1) | F.col("n_links").isNotNull())
        .select("h", "g", F.least("first", F.coalesce("other", "first")).alias("keeper"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def dedup_lines(docs: DataFrame, k: int = 2, shortest: int = 30) -> DataFrame:
    """Remove each line that an earlier one equals or nearly equals.

    Returns the columns of ``docs`` with ``text`` shortened, plus ``__n_lines`` (with a word), ``__removed`` (sorted
    line_no, doc_id, kept_line of the keeper, n_links) and ``__n_links`` (of all its lines). Earlier means by doc_id,
    then a hash of the row, then line number; null ids come first. Empty lines and null texts stay. Rows that are
    equal in doc_id and text are one document and come out alike. Lines under ``shortest`` characters go only if they
    are equal to an earlier one.
    """
    known = classes(docs, k, shortest)
    at = F.struct("doc_id", "row", "line_no")
    told = (
        lines_of(docs).select("doc_id", "row", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("again"), "line").alias("g"))
        .join(known, ["h", "g"])
        .groupBy(F.col("row").alias("__row"))
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("keeper") != at, F.struct(
                "line_no", F.col("keeper.doc_id").alias("doc_id"), F.col("keeper.line_no").alias("kept_line"), "n_links"
            )))).alias("__told"),
            F.sum("n_links").alias("__links"),
        )
    )
    none = "CAST(array() AS ARRAY<STRUCT<line_no: INT, doc_id: {0}, kept_line: INT, n_links: BIGINT>>)".format(dict(docs.dtypes)["doc_id"])
    kept = """array_join(flatten(transform(sequence(0, size(__removed)), j -> slice(__lines,
        coalesce(get(__removed, j - 1).line_no + 2, 1),
        coalesce(get(__removed, j).line_no, size(__lines)) - coalesce(get(__removed, j - 1).line_no + 1, 0)))), '\n')"""
    return (
        docs.withColumn("__row", row_key())
        .join(told, "__row", "left")
        .withColumn("__removed", F.coalesce("__told", F.expr(none)))
        .withColumn("__lines", F.split("text", "\n"))
        .withColumn("__n_lines", F.coalesce(F.expr(f"size(filter(__lines, l -> l rlike '{WORDED}'))".replace("\\", "\\\\")), F.lit(0)).cast("long"))
        .withColumn("__n_links", F.coalesce("__links", F.lit(0)))
        .withColumn("text", F.when(F.size("__removed") == 0, F.col("text")).otherwise(F.expr(kept.replace("\n)", "\\n)").replace("'\n'", "'\\n'"))))
        .select(*docs.columns, "__n_lines", "__removed", "__n_links")
    )
