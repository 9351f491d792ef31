import hashlib
import random
from array import array

from test_jaccard_join import brute as jaccard_brute
from test_phrase_index import brute as phrase_brute
from tokenizers import Tokenizer

import corpus_pipeline
from anchorline.llm import queries
from anchorline.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_each_stage_decides_on_what_the_last_one_kept(spark):
    docs = table(spark, SF, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.keys() <= before.keys()
        if name != "line_dedup":
            assert all(before[d] == t for d, t in after.items())
        else:
            assert after.keys() == before.keys() and all(len(t) <= len(before[d]) for d, t in after.items())
        sizes.append(len(after))
    # A copy has lost all its lines by the time near-duplicates are sought, so few or none may be left here.
    assert sizes[0] > sizes[1] == sizes[2] >= sizes[3] >= sizes[4] > sizes[0] // 2
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == sizes[-1]


def test_run_equals_the_stages_in_a_row(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = {tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = table(spark, SF, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    texts = {}
    for r in docs.orderBy("doc_id").collect():
        texts.setdefault(r["text"], []).append(r["doc_id"])
    assert any(len(ids) > 1 for ids in texts.values())
    assert all(not kept & set(ids[1:]) for ids in texts.values())


def test_no_benchmark_passage_stays(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()}
    planted = {
        d["doc_id"] for d in docs.collect() for i in items.collect()
        if " ".join(i["text"].lower().split()[:12]) in " ".join(d["text"].lower().split())
    }
    assert planted and not kept & planted and len(kept) > docs.count() // 2


def awkward(draw):
    """Documents with near copies, repeated rows, empty texts, a missing text and a very long one."""
    words = [f"w{n}" for n in range(300)]
    base = [[draw.choice(words) for _ in range(draw.randrange(20, 120))] for _ in range(10)]
    rows = []
    for d in range(90):
        text = list(draw.choice(base)) if draw.random() < 0.7 else [draw.choice(words) for _ in range(40)]
        for _ in range(draw.randrange(4)):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((d, " ".join(text)))
    return rows + [(200, ""), (201, None), (202, "one"), (203, "long " * 30_000 + "end"), (5, rows[5][1])]


def table_of(spark, rows):
    return spark.createDataFrame(
        [(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    )


def test_near_duplicate_and_decontamination_stages_equal_brute_force(spark, tmp_path):
    draw = random.Random(8)
    rows = awkward(draw)
    docs = table_of(spark, rows)
    root = jaccard_brute(rows)
    stays = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert stays == {d for d, _ in rows if root[d][0] == d} and len(stays) < len(root)
    items = [(1, rows[0][1]), (2, "one"), (3, None), (4, " ".join(rows[7][1].split()[3:13]))]
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()]
    clean = {d for d, _, hit, _ in phrase_brute(rows, items) if not hit}
    assert sorted(kept, key=str) == sorted(((d, t) for d, t in rows if d in clean), key=str) and len(kept) < len(rows)


def test_token_stage_equals_the_library(spark):
    rules = Tokenizer.from_str(queries.vocabulary())
    rules.no_truncation()
    rules.no_padding()
    rows = awkward(random.Random(9)) + [(None, "no id <|endoftext|> ümlaut")]
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.to_tokens(spark, table_of(spark, rows), SF).collect()), key=str)
    want = []
    for d, t in rows:
        ids = rules.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest()))
    assert got == sorted(want, key=str)
