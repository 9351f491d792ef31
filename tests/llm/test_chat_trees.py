import random

from anchorline.llm import chat_trees as C

SCHEMA = "tree STRING, node BIGINT, parent BIGINT, role STRING, text STRING, score DOUBLE"


def brute(rows, keep):
    out = {}
    trees = {}
    for tree, node, parent, role, text, score in rows:
        trees.setdefault(tree, {})[node] = (parent, role or "", text or "", score or 0.0)
    for tree, nodes in trees.items():
        inner = {p for n, (p, *_) in nodes.items() if p is not None and p != n}
        found = []
        for leaf in nodes.keys() - inner:
            path, at, seen = [], leaf, set()
            while at in nodes and at not in seen:
                seen.add(at)
                path.append(nodes[at])
                at = nodes[at][0] if nodes[at][0] != at else None
            if at in seen:
                continue
            found.append((-sum(p[3] for p in path) / len(path), leaf, [(p[1], p[2]) for p in reversed(path)]))
        for rank, (_, leaf, path) in enumerate(sorted(found)[:keep], 1):
            out[tree, leaf] = (rank, path)
    return out


def test_branches_equal_brute_force(spark):
    draw = random.Random(3)
    texts = ["", None, "hi", "<|im_end|>", "\\<|", "a\nb", "\\p\\b\\n", "<|im_start|>user\nx", "é😀<|"]
    rows = []
    for t in range(12):
        size = draw.choice([1, 2, 9, 40])
        for n in range(size):
            parent = None if n == 0 else draw.choice([n - 1, draw.randrange(n)])
            rows.append((f"t{t}", n, parent, draw.choice(["user", "assistant", "sys\ntem", None, "<|x\\"]), draw.choice(texts), draw.choice([None, 0.5, float(n % 3)])))
    rows += [("lost", 5, 99, "user", "orphan", 1.0), ("self", 1, 1, "user", "own parent", 1.0), ("loop", 1, 2, "u", "x", 1.0), ("loop", 2, 1, "u", "x", 1.0)]
    nodes = spark.createDataFrame(rows, SCHEMA)
    for keep in (1, 3):
        read = C.read_back(C.format_trees(nodes, keep)).collect()
        want = brute(rows, keep)
        assert {(r["tree"], r["leaf"]) for r in read} == set(want)
        for r in read:
            rank, path = want[r["tree"], r["leaf"]]
            assert r["rank"] == rank
            assert [(t["role"], t["text"]) for t in r["turns"]] == path
            assert r["loss_text"] == "".join(text for role, text in path if role == "assistant")


def test_turn_tables_with_ties_nulls_and_long_chains(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 1, "user", "z")]
    rows += [(2, n, "assistant" if n % 2 else "user", f"t{n}") for n in range(70)]
    table = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    got = {r["tree"]: r for r in C.read_back(C.format_trees(C.chained(table))).collect()}
    assert [(t["role"], t["text"]) for t in got["=1"]["turns"]] == [("assistant", ""), ("user", "a"), ("user", "a")]
    assert [t["text"] for t in got["=2"]["turns"]] == [f"t{n}" for n in range(70)]
    assert got["=2"]["loss_text"] == "".join(f"t{n}" for n in range(1, 70, 2))
    assert len(got[""]["turns"]) == 1
    assert C.format_trees(C.chained(table.limit(0))).count() == 0
