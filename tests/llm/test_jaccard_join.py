import random
import re

import numpy as np

from anchorline.llm import jaccard_join as J
from anchorline.llm.components import components


def sets(text):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows, threshold=0.8):
    found = {d: sets(t) for d, t in rows}
    near = {
        a: {b for b in found if a != b and found[a] and found[b]
            and len(found[a] & found[b]) >= threshold * len(found[a] | found[b]) - 1e-9}
        for a in found
    }
    root = {d: d for d in found}
    changed = True
    while changed:
        changed = False
        for a in near:
            least = min([root[a], *(root[b] for b in near[a])])
            if least < root[a]:
                root[a], changed = least, True
    same = {d: min(e for e in found if found[e] == found[d]) if found[d] else d for d in found}
    return {d: (root[d], same[d], len(near[d])) for d in found}


def corpus(draw):
    words = [f"w{n}" for n in range(400)]
    rows, base = [], [[draw.choice(words) for _ in range(draw.randrange(6, 160))] for _ in range(12)]
    for d in range(150):
        text = list(draw.choice(base)) if draw.random() < 0.8 else [draw.choice(words) for _ in range(60)]
        for _ in range(draw.randrange(6)):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((d, draw.choice([" ", "  ", ", "]).join(text) + draw.choice(["", ".", "!"])))
    return rows + [(500, ""), (501, None), (502, "one"), (503, "One."), (504, "?!"), (505, "one two")]


def test_equals_brute_force(docs, monkeypatch):
    rows = corpus(random.Random(3))
    want = brute(rows)
    got = {r["doc_id"]: (r["class_id"], r["text_class"], r["n_links"]) for r in J.near_duplicates(docs(rows)).collect()}
    assert got == want
    assert sum(v[2] for v in want.values()) > 100


def test_chunks_of_large_groups_lose_no_pair(docs, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 16)
    rows = corpus(random.Random(4))
    got = {r["doc_id"]: (r["class_id"], r["text_class"], r["n_links"]) for r in J.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def test_repeated_ids_nulls_and_empty_table(spark, docs):
    rows = spark.createDataFrame([(None, "a b c", 1), (7, "a b c", 2), (7, "a b c", 3)], "doc_id BIGINT, text STRING, links INT")
    got = sorted(((r["doc_id"], r["class_id"]) for r in J.near_duplicates(rows).collect()), key=str)
    assert [g[0] for g in got] == [7, 7, None]
    assert got[0] == (7, 7)
    assert J.near_duplicates(docs([])).count() == 0


def test_similar_both_ways():
    draw = np.random.default_rng(1)
    found = [np.unique(draw.integers(0, 40, 30).astype(np.uint64)) for _ in range(12)]
    left, right = np.triu_indices(12, 1)
    want = [len(np.intersect1d(found[a], found[b])) >= 0.5 * len(np.union1d(found[a], found[b])) for a, b in zip(left, right)]
    assert J.similar(found, left, right, 0.5).tolist() == want
    assert [bool(J.similar(found, left[n : n + 1], right[n : n + 1], 0.5)[0]) for n in range(len(left))] == want


def test_components_of_long_chains(spark):
    edges = [(n, n + 1) for n in range(0, 60)] + [(100, 105), (105, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {**{n: 0 for n in range(61)}, 100: 100, 101: 100, 105: 100}
