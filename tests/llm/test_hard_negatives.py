import random

from pyspark.sql import functions as F

from anchorline.llm import hard_negatives

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def quantised(v):
    import math

    return [math.floor(256 * x) for x in v]


def brute(rows, every, percent=80, positives=5, negatives=5):
    best = {}
    for i, v, lab in rows:
        if i is None or lab is None or not v or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        row = (lab, quantised(v))
        best[i] = min(best.get(i, row), row)
    out = []
    for a, (lab, q) in best.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, r)), i, l) for i, (l, r) in best.items() if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            near = sorted(x for x in scored if x[2] != lab and percent * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(near, 1)]
    return sorted(out)


def vectors(seed, n, d=8, labels=4, spread=0.4):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(d)] for _ in range(labels)]
    rows = []
    for i in range(n):
        c = draw.choice(centres)
        rows.append((i, [draw.choice([0.5, 1.0, 2.0]) * (x + draw.gauss(0, spread)) for x in c], draw.randrange(labels)))
    return rows


def mined(spark, rows, every, **more):
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % every == 0, **more)
    return sorted(tuple(r) for r in found.collect())


def exact(rows):
    """What the table holds: single-precision numbers."""
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]


def test_mining_equals_brute_force_in_blocks_of_any_size(spark):
    rows = vectors(3, 260)
    want = brute(exact(rows), 10)
    assert want
    assert mined(spark, rows, 10, size=16) == want
    assert mined(spark, rows, 10, count=1) == want


def test_equal_vectors_zero_vectors_and_rows_that_cannot_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5, -0.25], i % 3) for i in range(60)] + [
        (100, [0.0, 0.0, 0.0], 1), (101, [0.0, 0.0, 0.0], 1), (102, [0.0, 0.0, 0.0], 2), (110, [1.0], 1), (111, [1.0, 0.5, -0.25, 3.0], 2),
        (120, [nan, 1.0, 1.0], 1), (121, [inf, 1.0, 1.0], 1), (122, [None, 1.0, 1.0], 1), (123, None, 1), (124, [1.0, 1.0, 1.0], None),
        (None, [1.0, 1.0, 1.0], 1), (125, [], 1), (126, [-1.0, -0.5, 0.25], 0), (20, [1.0, 0.5, -0.25], 2), (20, [1.0, 0.5, -0.25], 2),
        (30, [-5.0, 0.5, 0.25], 0),
    ]
    assert mined(spark, rows, 10, size=7) == brute(exact(rows), 10)


def test_negative_scores_and_thresholds(spark):
    rows = vectors(8, 120, d=3, spread=1.5)
    for percent in (0, 50, 100):
        assert mined(spark, rows, 6, percent=percent, size=20) == brute(exact(rows), 6, percent)


def test_sums_beyond_doubles_are_exact(spark):
    draw = random.Random(2)
    rows = [(i, [draw.uniform(-1, 1) * 2.0**18 for _ in range(4)], i % 2) for i in range(80)]
    assert mined(spark, rows, 8, size=16) == brute(exact(rows), 8)
    huge = [(i, [3e38, -3e38], i % 2) for i in range(6)]
    assert {r[4] for r in mined(spark, huge, 2)} == {hard_negatives.LONG[1]}


def test_one_label_has_no_negatives_and_empty_tables_give_none(spark):
    assert mined(spark, [(i, [1.0, float(i)], 1) for i in range(20)], 5) == []
    assert mined(spark, [], 5) == []
    table = spark.createDataFrame([(i, [1.0, 2.0], i % 2, "x", 5) for i in range(12)], SCHEMA + ", block STRING, anchor INT")
    assert hard_negatives.mine(table, F.col("id") % 4 == 0).count() == 3 * 5 * 5


def test_anchors_travel_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK_BYTES", 4000)
    rows = vectors(5, 200)
    assert mined(spark, rows, 4, size=8) == brute(exact(rows), 4)


def test_bounds_hold(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    for _ in range(50):
        q = np.floor(256 * draw.normal(size=(40, 6)))
        refs = hard_negatives._scaled(draw.normal(size=(5, 6)))[0]
        unit, norms = hard_negatives._scaled(q)
        angles = np.arccos(np.clip(unit @ refs.T, -1, 1))
        low, high = hard_negatives._bounds(angles[0], norms[0], angles, angles, (norms, norms))
        scores = q @ q[0]
        assert (low <= scores).all() and (scores <= high).all()
        low, high = hard_negatives._bounds(angles, norms, angles[:9].min(axis=0), angles[:9].max(axis=0), (norms[:9].min(), norms[:9].max()))
        scores = q @ q[:9].T
        assert (low[:, None] <= scores).all() and (scores <= high[:, None]).all()
