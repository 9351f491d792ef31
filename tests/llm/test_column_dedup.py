import random
from collections import Counter

from pyspark.sql import functions as F

from anchorline.llm import column_dedup as C


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(d[n : n + length] for d in data for n in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data, strict=True):
        gone = set()
        for n in range(len(d) - length + 1):
            if count[d[n : n + length]] > 1:
                gone.update(range(n, n + length))
        runs = sum(n - 1 not in gone for n in gone)
        out.append((doc, len(d), bytes(d[n] for n in range(len(d)) if n not in gone), runs))
    return sorted(out, key=str)


def corpus(draw):
    text = lambda n: "".join(draw.choice("abcdeé \n") for _ in range(n))
    shared = [text(draw.choice([60, 80, 120])) for _ in range(4)]
    rows = [(n, text(draw.randrange(200)) + draw.choice(shared) + text(draw.randrange(80)) + draw.choice(["", *shared])) for n in range(60)]
    rows += [(100 + n, rows[n][1]) for n in range(5)] + [(200, "ab" * 90), (201, "x" * 150), (202, None), (203, ""), (204, "x" * 63)]
    return rows + [(205, "bab" + "ab" * 60), (5, rows[5][1]), (None, text(70) + shared[0])]


def check(docs, rows, length):
    got = sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["removed"])) for r in C.dedup_bytes(docs(rows), length).collect()), key=str)
    assert got == brute(rows, length)


def test_equals_brute_force(docs):
    rows = corpus(random.Random(2))
    check(docs, rows, 64)
    check(docs, rows, 200)


def test_crowded_anchors_take_the_exact_other_way(docs, monkeypatch):
    monkeypatch.setattr(C, "CROWD", 4)
    check(docs, corpus(random.Random(6)), 64)


def test_long_texts_are_cut_into_pieces_without_seams(docs, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 50)
    check(docs, corpus(random.Random(8)), 64)


def test_empty_table(docs):
    assert C.dedup_bytes(docs([])).count() == 0


def test_equal_contexts_of_a_text_are_settled_in_one_row(spark, docs, monkeypatch):
    found = spark.createDataFrame([(1, 7, 8, n, n + 2) for n in range(0, 50, 10)] + [(2, 7, 8, 0, 2)], "row LONG, h LONG, g LONG, first LONG, last LONG")
    got = {r["row"]: sorted(tuple(p) for p in r["places"]) for r in C.gathered(found, 64).collect()}
    assert got == {1: [(n, n + 66) for n in range(0, 50, 10)], 2: [(0, 66)]}
    monkeypatch.setattr(C, "CROWD", 4)
    draw = random.Random(11)
    line = "".join(draw.choice("abcdefgh") for _ in range(90)) + "\n"
    check(docs, [(1, line * 9 + "end"), (2, "x" + line * 3), (3, line), (4, line[:70])], 64)


def test_repeats_cross_the_join_gathered_and_leave_it_as_runs(spark, docs, monkeypatch):
    plans = {}

    def seen(df, name, keep=C.stored):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return keep(df, name)

    monkeypatch.setattr(C, "stored", seen)
    monkeypatch.setattr(C, "CROWD", 4)
    line = "".join(random.Random(12).choice("abcdefgh") for _ in range(90)) + "\n"
    check(docs, [(1, line * 9 + "end"), (2, "x" + line * 3), (3, line)], 64)
    # The join that settles copies stands above the gathering, so it sees a text's equal contexts once.
    depth = {word: [len(t) - len(t.lstrip(" :+-")) for t in plans["column-ranges"] if word in t] for word in ("Join Inner", "collect_list")}
    assert min(depth["Join Inner"], default=99) < min(depth["collect_list"])
    places = spark.createDataFrame([([(30, 40), (0, 10), (5, 15), (15, 25), (0, 10)],)], "places ARRAY<STRUCT<start: INT, stop: INT>>")
    assert [tuple(r) for r in places.select(F.inline(C.runs_of("places"))).collect()] == [(0, 25), (30, 40)]
