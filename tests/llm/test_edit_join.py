import random

import corpus_pipeline
import pytest
from anchorline.llm import edit_join, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def edited(text, n, draw):
    for _ in range(n):
        at = draw.randrange(len(text))
        text = draw.choice([text[:at] + "é" + text[at:], text[:at] + text[at + 1 :], text[:at] + " " + text[at + 1 :]])
    return text


def corpus(draw, n=60):
    base = ["".join(draw.choice("abcde é") for _ in range(draw.randrange(31, 60))).replace("  ", " a") for _ in range(12)]
    rows = []
    for d in range(n):
        lines = [edited(draw.choice(base), draw.randrange(5), draw) for _ in range(draw.randrange(1, 6))]
        rows.append((d, "\n".join(lines + draw.choice([[], [""], ["short"], ["   "]]))))
    return rows


def brute(rows, k, shortest):
    lines = {}
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                lines.setdefault(line, []).append((d, n))
    near = {a: {b for b in lines if a != b and min(len(a), len(b)) >= shortest and distance(a, b) <= k} for a in lines}
    gone, links = {}, {}
    for line, places in lines.items():
        keeper = min([min(places), *(min(lines[o]) for o in near[line])])
        for p in places:
            links[p[0]] = links.get(p[0], 0) + len(near[line])
            if p != keeper:
                gone.setdefault(p[0], []).append((p[1], *keeper))
    return {d: (sorted(gone.get(d, [])), links.get(d, 0)) for d, _ in rows}


def test_dedup_lines_equals_brute_force(docs):
    rows = corpus(random.Random(5)) + [(900, None), (901, ""), (902, "\n\n"), (903, "short"), (904, "😀" * 40), (905, "😀" * 39 + "x")]
    for k in (1, 2, 3):
        got = {r["doc_id"]: r for r in edit_join.dedup_lines(docs(rows), k).collect()}
        want = brute(rows, k, 30)
        assert len(got) == len(rows)
        for d, text in rows:
            removed = [(r["line_no"], r["doc_id"], r["kept_line"]) for r in got[d]["__removed"]]
            assert (removed, got[d]["__n_links"]) == want[d], (k, d)
            drop = {n for n, *_ in removed}
            assert got[d]["text"] == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop))


@pytest.mark.parametrize("block", [3, 256])
def test_crowded_keys_are_counted_in_blocks(docs, monkeypatch, block):
    for name, value in (("SHARE", 2), ("SEEN", 3), ("BLOCK", block)):
        monkeypatch.setattr(edit_join, name, value)
    draw = random.Random(block)
    line = "the quick brown fox jumps over the lazy dog and runs"
    hot = [edited(line, draw.randrange(1, 4), draw) for _ in range(90)]
    rows = [(d, "\n".join([hot[d], draw.choice(hot)])) for d in range(90)] + [(1000 + d, t) for d, t in corpus(draw, 20)]
    got = {r["doc_id"]: r for r in edit_join.dedup_lines(docs(rows), 2).collect()}
    want = brute(rows, 2, 30)
    assert sum(w[1] for w in want.values()) > 500
    for d, _ in rows:
        removed = [(r["line_no"], r["doc_id"], r["kept_line"]) for r in got[d]["__removed"]]
        assert (removed, got[d]["__n_links"]) == want[d], d


def test_repeated_rows_extra_columns_and_empty_table(spark, docs):
    line = "a line that is long enough to be looked at closely"
    rows = spark.createDataFrame([(1, line, 7, "x"), (1, line, 8, "y"), (None, line + "s", 9, "z")], "doc_id BIGINT, text STRING, line INT, h STRING")
    got = edit_join.dedup_lines(rows)
    assert got.columns[:4] == ["doc_id", "text", "line", "h"]
    kept = sorted((r["line"], r["text"]) for r in got.collect())
    assert kept == [(7, ""), (8, ""), (9, line + "s")]
    assert edit_join.dedup_lines(docs([])).count() == 0


def test_short_lines_of_op7_and_the_pipeline_equal_brute_force(spark, docs, tmp_path):
    draw = random.Random(9)
    base = ["".join(draw.choice("abcde é") for _ in range(draw.randrange(6, 31))) for _ in range(12)]
    rows = [(d, "\n".join(edited(draw.choice(base), draw.randrange(4), draw) for _ in range(4))) for d in range(60)]
    rows += [(100, "Eding enin."), (101, "Eding in."), (102, "Und | äbe."), (103, "Und äbe."), (104, "And.\nAre."), (105, "sevenab\nsevenabc")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows, 2, 8)
    got = {r["doc_id"]: r for r in queries.op7(spark, str(tmp_path)).collect()}
    staged = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs(rows), str(tmp_path)).collect()}
    for d, text in rows:
        gone = [n for n, *_ in want[d][0]]
        assert (got[d]["removed_lines"], got[d]["keeper_doc_ids"], got[d]["n_links"]) == (gone, [k for _, k, _ in want[d][0]], want[d][1]), d
        assert staged[d] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
    assert got[101]["keeper_doc_ids"] == [100] and got[103]["keeper_doc_ids"] == [102]
    assert got[104]["n_removed"] == got[105]["n_removed"] == 0
