import numpy as np
from pyspark.sql import functions as F

from anchorline.llm import pairwise_quality, toxicity
from anchorline.llm.labelled import held_out, training_sample

SF = "/root/testdata/sf0.01"


def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


def auc(truth, score):
    truth, score = np.array(truth), np.array(score)
    good, bad = score[truth == 1], score[truth == 0]
    return np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad])


def test_toxicity_on_held_out_documents(spark):
    docs, labels = tables(spark)
    rows = toxicity.verdicts(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert 40 < len(held) < len(rows)
    assert auc([r["toxic"] for r in held], [r["score"] for r in held]) > 0.9
    clean = [r for r in held if not r["toxic"]]
    assert np.mean([r["predicted"] for r in clean]) < 0.03


def test_toxicity_locates_sentences_and_rejects(spark, docs):
    model = toxicity.Model(-6.0, {"nasty": 9.0, "kind": -9.0})
    rows = [(1, "All is well. You nasty thing! More follows."), (2, None), (3, "..."), (4, "nice day"), (None, "NASTY"), (4, "nice day")]
    got = toxicity.score(docs(rows), model).collect()
    assert [r["doc_id"] for r in got] == [1, 2, 3, 4, None, 4]
    assert [(s["start"], s["end"]) for s in got[0]["offending"]] == [(12, 28)]
    chances = [1 / (1 + np.exp(6.0)), 1 / (1 + np.exp(-3.0)), 1 / (1 + np.exp(6.0))]
    assert abs(got[0]["score"] - (1 - np.prod(1 - np.array(chances)))) < 1e-12
    assert got[1]["score"] == got[2]["score"] == 0.0
    extra = spark.createDataFrame([(*r, 9) for r in rows], "doc_id BIGINT, text STRING, score INT")
    assert [(r["doc_id"], r["score"]) for r in toxicity.reject(extra, model).collect()] == [(2, 9), (3, 9), (4, 9), (4, 9)]


def test_quality_on_held_out_documents(spark):
    docs, labels = tables(spark)
    rows = pairwise_quality.score(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert auc([r["quality"] for r in held], [r["score"] for r in held]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_missing_labels_nulls_and_empty_tables(spark, docs):
    rows = docs([(1, None), (2, ""), (3, "words"), (3, "words"), (None, "x")])
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    assert [r["predicted"] for r in toxicity.verdicts(rows, none).collect()] == [0] * 5
    assert [r["predicted"] for r in pairwise_quality.score(rows, none).collect()] == [1] * 5
    assert toxicity.verdicts(docs([]), none).count() == 0 == pairwise_quality.score(docs([]), none).count()
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (2, None)], "doc_id BIGINT, toxic INT")
    assert {(r["doc_id"], r["label"]) for r in training_sample(rows, labels, "toxic", 10, 100).collect()} == {(3, 1)}


def test_quality_learns_from_every_labelled_row(spark):
    docs, labels = tables(spark)
    seen = pairwise_quality.measured(docs)
    base = pairwise_quality.fit(seen, labels)
    known = labels.filter("quality IS NOT NULL").join(docs, "doc_id").filter(~held_out()).count()
    assert 0 < base.quantile < 1 and abs(base.quantile * known - round(base.quantile * known)) < 1e-6
    # Neither a row limit nor a length limit: a text of any length moves the model, and partitions do not.
    long = docs.limit(1).select(F.lit(1000000000002).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), F.repeat(F.lit("| "), 150_000).alias("text"))
    told = labels.select("doc_id", "quality", "toxic").unionByName(long.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    more = pairwise_quality.fit(pairwise_quality.measured(docs.select("doc_id", "text").unionByName(long)), told)
    assert more.weights != base.weights
    again = pairwise_quality.fit(pairwise_quality.measured(docs.repartition(7)), labels)
    assert np.allclose(again.weights, base.weights, rtol=1e-6, atol=1e-6) and abs(again.cut - base.cut) < 1e-6
