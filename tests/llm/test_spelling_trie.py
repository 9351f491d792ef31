import random
import re
import zlib
from collections import Counter

import pytest

from anchorline.llm import queries, spelling_trie as trie

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, change=True):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if change and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(words, ratio=10):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(((-words[x], x) for x in others), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def found(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def edited(word, draw, letters):
    at = draw.randrange(len(word))
    return draw.choice([word[:at] + draw.choice(letters) + word[at:], word[:at] + word[at + 1 :], word[:at] + draw.choice(letters) + word[at + 1 :]])


def vocabulary(seed, letters, n=40, edits=14):
    draw = random.Random(seed)
    base = ["".join(draw.choice(letters) for _ in range(draw.randrange(7, 13))) for _ in range(n)]
    words = set(base)
    for w in base:
        for _ in range(edits):
            x = edited(w, draw, letters)
            words |= {x, edited(x, draw, letters)}
    return {w: draw.choice([2, 3, 20, 30, 200, 3000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize("letters", ["ab", "abcdé", "aaaaab", "éàÿ÷"])
def test_near_words_equal_brute_force(spark, letters):
    words = vocabulary(len(letters), letters)
    got = found(trie.variants(spark.createDataFrame(sorted(words.items()), "word STRING, n BIGINT")))
    assert got == brute(words)


def test_runs_of_one_letter_and_very_long_words(spark):
    draw = random.Random(4)
    long = "".join(draw.choice("abcdefgh") for _ in range(20_000))
    words = {"a" * n: 2 + n for n in range(7, 30)} | {long: 500, long[:15_000] + long[15_001:]: 4, long[:90] + "z" + long[91:]: 3, long + "x": 2, "x" + long: 2}
    words |= {"a" * 12 + "b": 9, "b" + "a" * 12: 9, "a" * 6 + "b" + "a" * 6: 900}
    assert found(trie.variants(spark.createDataFrame(sorted(words.items()), "word STRING, n BIGINT"))) == brute(words)


def test_forms_are_followed_to_the_last_and_ties_go_to_the_smallest(spark):
    words = {"abcdefg": 10_000_000, "abcdefgh": 1_000_000, "abcdefghi": 100_000, "abcdefghij": 10_000, "abcdefghijk": 1_000,
             "zzzzzzz": 2, "zzzzzzb": 20, "zzzzzzé": 20, "unrelated": 5}
    got = {r[0]: r for r in found(trie.variants(spark.createDataFrame(sorted(words.items()), "word STRING, n BIGINT")))}
    assert got["abcdefghijk"][2] == "abcdefg" and got["zzzzzzz"][1] == "zzzzzzb"
    assert got["unrelated"][1:] == (None, "unrelated", 5, 0, None)
    assert sorted(got.values()) == brute(words)


def test_words_are_counted_over_whole_texts(docs):
    rows = [
        (1, "Schwarz schwarze SCHWARZE Schwärze"), (2, None), (3, ""), (None, "Wortlaut wortlaut"), (4, "x" * 50 + " " + "x" * 50),
        (5, "seven77 sevenseven,sevenseven"), (6, "ÀÉÎÕÜÝÞ àéîõüýþ"), (7, "word " * 60_000 + "atlasting atlasting"), (1, "Schwarze"),
    ] + [(n, "repeated repeated letters lettres") for n in range(100, 200)]
    got = {r["word"]: r["n"] for r in trie.count_words(docs(rows), trie.slipped).collect()}
    assert got == counted(rows)
    assert {r["word"]: r["n"] for r in trie.count_words(docs(rows)).collect()} == counted(rows, change=False)


def test_op11_equals_brute_force(spark, docs, tmp_path):
    draw = random.Random(11)
    pool = list(vocabulary(6, "abcd", 12, 3))
    rows = [(n, " ".join(draw.choice(pool[: 1 + draw.randrange(len(pool))]) for _ in range(draw.randrange(80)))) for n in range(80)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_spelling_trie"](spark, str(tmp_path))
    want = brute(counted(rows))
    assert any(r[1] for r in want)
    assert found(got) == want


def test_empty_tables_and_other_columns(spark, docs):
    assert trie.variants(trie.count_words(docs([]))).count() == 0
    clash = spark.createDataFrame([("a", "somewords somewords", 1, "x", 2)], "doc_id STRING, text STRING, n INT, word STRING, node INT")
    assert found(trie.variants(trie.count_words(clash))) == [("somewords", None, "somewords", 2, 0, None)]
    words = spark.createDataFrame([("somewords", 2, 1)], "word STRING, n BIGINT, at INT")
    assert len(found(trie.variants(words))) == 1
    with pytest.raises(ValueError):
        trie.variants(words, ratio=1)
