import random
import re
import unicodedata
from collections import Counter

from anchorline.llm import quality_rules as Q, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[n : n + 8]) for n in range(len(words) - 7)]
    twice = Counter(grams)
    hit = {n + k for n, g in enumerate(grams) if twice[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_measures_equal_brute_force(docs):
    draw = random.Random(1)
    words = ["a", "bb", "É", "#x", "<|", "word", "😀", "\x85", " ", "z" * 30]
    rows = [(n, "".join(draw.choice(words) + draw.choice([" ", "\n", "\t", "  ", "\x0b"]) for _ in range(draw.choice([0, 3, 9, 40, 300])))) for n in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "x " * 50), (104, ("one two three four five six seven eight nine\n" * 3)), (103, "x " * 50), (None, "q")]
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in Q.ledger(docs(rows)).collect())
    assert got == Counter((d, *brute(t)) for d, t in rows)


def test_policies_and_ablations_come_from_the_bits(spark, docs):
    rows = [(1, "plain words " * 3), (2, "different words every time so nothing at all repeats in this long and honest sentence of clean prose here"),
            (3, "# " + "&&x " * 30), (4, None)]
    ledger = Q.ledger(docs(rows)).cache()
    kept = {r["doc_id"]: (r["kept"], r["sole_rule"]) for r in Q.judge(ledger, "v1").collect()}
    assert kept[2] == (False, "few_words") or kept[2][0]
    assert kept[4] == (False, "few_words") and not kept[3][0]
    for policy in Q.POLICIES:
        bits = [r["failed"] & Q.mask_of(Q.POLICIES[policy]) for r in ledger.collect()]
        told = {r["rule"]: r for r in Q.ablations(ledger).filter(f"policy = '{policy}'").collect()}
        assert set(told) == set(Q.POLICIES[policy])
        for rule in Q.RULES:
            if rule.name in told:
                bit = 1 << rule.bit
                assert told[rule.name]["n_rejected"] == sum(b != 0 for b in bits)
                assert told[rule.name]["n_failed"] == sum(b & bit != 0 for b in bits)
                assert told[rule.name]["n_rejected_without"] == sum(b & ~bit != 0 for b in bits)
                assert told[rule.name]["n_only_this"] == sum(b == bit for b in bits)


def test_empty_table_and_clashing_columns(spark, docs):
    assert Q.ablations(Q.ledger(docs([]))).count() == 0
    rows = spark.createDataFrame([(1, "a b", "words", 3)], "doc_id BIGINT, text STRING, words STRING, failed INT")
    assert Q.ledger(rows).first()["n_words"] == 2


def test_every_policy_and_its_ablations_over_whole_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fails = {}
    for d, text in texts.items():
        n, chars, symbols, twice, repeated = brute(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        upper = sum(unicodedata.category(c) == "Lu" for c in text or "")
        told = (n < 20, 100 * repeated > 30 * n, 10 * symbols > n, 10 * twice > 3 * lines, not 2 * n <= chars <= 15 * n, 2 * upper > chars)
        fails[d] = {r.name for r, hit in zip(Q.RULES, told, strict=True) if hit}
    verdicts = {r["doc_id"]: r for r in queries.QUERIES["op1_verdicts"](spark, "/root/testdata/sf0.001").collect()}
    assert verdicts.keys() == texts.keys()
    want = set()
    for policy, rules in Q.POLICIES.items():
        hit = {d: f & set(rules) for d, f in fails.items()}
        for d, h in hit.items():
            assert verdicts[d][f"kept_{policy}"] == (not h)
            assert verdicts[d][f"sole_rule_{policy}"] == (min(h) if len(h) == 1 else None)
        for rule in rules:
            want.add((policy, rule, len(texts), sum(rule in f for f in fails.values()), sum(bool(h) for h in hit.values()),
                      sum(bool(h - {rule}) for h in hit.values()), sum(h == {rule} for h in hit.values())))
    assert {tuple(r) for r in queries.QUERIES["op1_rule_ablations"](spark, "/root/testdata/sf0.001").collect()} == want
