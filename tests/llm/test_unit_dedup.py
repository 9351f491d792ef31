import hashlib
import random
import re

from anchorline.llm import queries, unit_dedup


def test_keeps_the_earliest_occurrence(docs):
    passage = "Here is a passage of seven words. And another that also has seven words."
    rows = [(1, "Own words that nobody else has written.\n" + passage), (2, "start " + passage + " end"),
            (3, passage), (4, None), (5, ""), (6, "tiny line\ntiny line"), (7, "ONE two three four five six!\nOne two, three four five six")]
    got = {r["doc_id"]: r for r in unit_dedup.dedup_units(docs(rows)).collect()}
    assert got[1]["removed"] == [] and got[1]["kept"] == rows[0][1]
    # The first sentence runs on from another word in document 2; the second is whole.
    assert got[2]["kept"] == "start Here is a passage of seven words. end"
    assert [(s["start"], s["first"]["doc_id"]) for s in got[3]["removed"]] == [(0, 1), (0, 1), (33, 1)]
    assert got[3]["kept"] == ""
    assert got[4]["kept"] is None and got[5]["kept"] == "" and got[6]["kept"] == rows[5][1]
    assert got[7]["kept"] == "ONE two three four five six!\n"


def test_agrees_with_brute_force_on_the_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = sorted((r["doc_id"], r["text"]) for r in rows.collect())
    seen, want = set(), {}
    for d, text in texts:
        drop = set()
        at = 0
        for line in (text or "").split("\n"):
            found, here = [], 0
            for part in re.split(r"(?<=[.!?])(?![.!?])", line):
                words = re.findall(r"\w+", part.lower())
                body = part.lstrip(".!?")
                found.append((at + here + len(part) - len(body), at + here + len(part), words))
                here += len(part)
            found = [f for f in found if f[2]]
            units = [(at, at + len(line), [w for f in found for w in f[2]])] * (len(found) > 1) + found
            for a, b, words in units:
                if len(words) >= 6:
                    if tuple(words) in seen:
                        drop.update(range(a, b))
                    seen.add(tuple(words))
            at += len(line) + 1
        want[d] = "".join(c for n, c in enumerate(text or "") if n not in drop)
    got = {r["doc_id"]: r["kept"] for r in unit_dedup.dedup_units(rows).collect()}
    assert got == want


def test_empty_table_and_equal_rows(spark, docs):
    assert unit_dedup.dedup_units(docs([])).count() == 0
    text = "one two three four five six seven"
    rows = spark.createDataFrame([(1, text, 1), (1, text, 2), (None, text, 3)], "doc_id BIGINT, text STRING, row INT")
    assert sorted(r["kept"] for r in unit_dedup.dedup_units(rows).collect()) == ["", "", text]


def test_short_lines_go_and_short_sentences_inside_lines_stay(spark, docs, tmp_path):
    draw = random.Random(3)
    line = lambda n: " ".join(draw.choice("abc") for _ in range(n))
    rows = [(d, "\n".join(draw.choice(["", "--", "{0}", "{0}!", "Yes. {0}"]).format(line(draw.randrange(1, 7))) for _ in range(8))) for d in range(40)]
    rows += [(100, "All rights reserved."), (101, "ALL rights, reserved"), (102, "All rights reserved. Own words. Yes."), (103, "... Yes."), (104, "yes")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5(spark, str(tmp_path)).collect()}
    seen = set()
    for d, text in rows:
        at, starts, kept = 0, [], []
        for whole in text.split("\n"):
            words = tuple(re.findall(r"\w+", whole.lower()))
            body = whole.removeprefix("... ") if whole.startswith("...") else whole
            if words and words in seen:
                starts.append(at + (3 if body != whole else 0))
                kept.append("..." if body != whole else "")
            else:
                kept.append(whole)
            # The only sentences of six words or more stand after "Yes.".
            if whole.startswith("Yes. ") and len(words) == 7:
                if words[1:] in seen:
                    starts.append(at + 4)
                    kept[-1] = kept[-1] and "Yes."
                seen.add(words[1:])
            seen |= {words} if words else set()
            at += len(whole) + 1
        assert got[d]["starts"] == sorted(starts), (d, text)
        assert got[d]["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert got[101]["first_doc_ids"] == [100] and got[102]["n_removed"] == 0
