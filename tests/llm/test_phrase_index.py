import hashlib
import random
import re
from collections import Counter

from anchorline.llm import phrase_index as P, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(P.UPPER, P.LOWER)))


def brute(docs, items, size=10):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, t in items:
            v = words(t)
            k = min(size, len(v))
            grams = {tuple(v[n : n + k]) for n in range(len(v) - k + 1)} if v else set()
            for n in range(len(w) - k + 1):
                if k and tuple(w[n : n + k]) in grams:
                    hit.update(range(n, n + k))
                    found.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_equals_brute_force(spark, docs):
    draw = random.Random(1)
    vocab = ["the", "of", "É", "Ünd", "x1", *[f"w{n}" for n in range(30)]]
    items = [(n, " ".join(draw.choice(vocab) for _ in range(draw.choice([1, 2, 5, 10, 11, 25])))) for n in range(20)]
    items += [(100, None), (101, "..."), (None, "rareword another"), (5, items[5][1]), (102, "the the the the the the the the the the the")]
    rows = [(n, " ".join(draw.choice(vocab) for _ in range(draw.randrange(120)))) for n in range(40)]
    rows += [(n + 50, f"{rows[n][1]}, {items[draw.randrange(20)][1].upper()}. {rows[n + 1][1]}") for n in range(30)]
    rows += [(200, None), (201, ""), (202, "the " * 50), (203, "RareWord-ANOTHER"), (7, rows[7][1]), (None, items[3][1])]
    for size in (10, 3):
        found = P.contamination(docs(rows), spark.createDataFrame(items, "item_id BIGINT, text STRING"), size)
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found.collect()), key=str)
        assert got == brute(rows, items, size)
        assert any(g[2] for g in got)


def test_empty_tables_and_clashing_columns(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id BIGINT, text STRING")
    assert P.contamination(docs([]), items).count() == 0
    none = P.contamination(docs([(1, "alpha beta gamma")]), items.limit(0)).collect()
    assert [(r["n_hit"], r["items"]) for r in none] == [(0, [])]
    rows = spark.createDataFrame([(1, "x Alpha beta, gamma", 5, 6)], "doc_id BIGINT, text STRING, row INT, starts INT")
    got = P.contamination(rows, items).collect()[0]
    assert (got["row"], got["starts"], got["n_hit"]) == (5, 6, 3)


def test_proximity_in_any_order(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta")], "item_id BIGINT, text STRING")
    rows = docs([(1, "beta q q alpha"), (2, "alpha " + "q " * 30 + "beta"), (3, "gamma delta"), (4, None), (5, "alpha alpha delta delta gamma")])
    got = {r["near"] for r in P.proximity_matches(rows, items, slop=5).collect()}
    assert got == {3}


def near_brute(docs, items, slop=20, size=10):
    counts = Counter(w for _, t in docs for w in words(t))
    pairs = set()
    for i, t in items:
        v = words(t)
        k = min(size, len(v))
        for s in range(len(v) - k + 1 if v else 0):
            rare = sorted((counts[v[at]], at) for at in range(s, s + k))[:2]
            if rare[0][0]:
                pairs.add(("" if i is None else str(i), v[rare[0][1]], v[rare[-1][1]], len(rare) == 1))
    out = {}
    for d, t in docs:
        places = {}
        for n, w in enumerate(words(t)):
            places.setdefault(w, []).append(n)
        near = {}
        for item, a, b, single in pairs:
            for gap in (abs(p - q) for p in places.get(a, ()) for q in places.get(b, ())):
                if gap <= slop and (gap or single):
                    near[item] = min(near.get(item, gap), gap)
        told = ",".join(f"{i}:{n}" for i, n in sorted(near.items()))
        out[d] = (len(near), min(near.values(), default=None), hashlib.sha256(told.encode()).hexdigest())
    return out


def test_proximity_query_equals_brute_force(spark, docs, tmp_path):
    draw = random.Random(4)
    vocab = ["the"] * 12 + ["of", "É", "Ünd", *[f"w{n}" for n in range(60)]]
    items = [(n, " ".join(draw.choice(vocab) for _ in range(draw.choice([1, 2, 5, 10, 11, 25])))) for n in range(20)]
    items += [(100, None), (None, "w1 w2"), (5, "w3 w4 the"), (101, "the the the"), (102, "the nowhere")]
    rows = [(n, " ".join(draw.choice(vocab) for _ in range(draw.randrange(200)))) for n in range(50)]
    rows += [(200, None), (201, ""), (202, "the " * 500), (203, "w1 " + "x " * 25 + "w2"), (204, "w1 " + "x " * 19 + "w2 w2")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op4_proximity"](spark, str(tmp_path)).collect()}
    assert got == near_brute(rows, items)
    assert sum(g[0] > 0 for g in got.values()) > 20 and got[200][:2] == (0, None)
