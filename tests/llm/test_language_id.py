import random

import numpy as np
from linetrail.llm import language_id as li
from pyspark.sql import functions as F


def corpus(n, seed):
    rng = random.Random(seed)
    parts = {"aa": "ka lo mi tu ne".split(), "bb": "schr ein ung keit öff".split(), "cc": "tion eau oux ché ais".split()}
    out = []
    for i in range(n):
        lang = rng.choice(list(parts))
        out.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 40))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(docs, F.col("doc_id") % 4 != 2)
    got = li.classify(docs, model).where("doc_id % 4 = 2").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert np.mean([r.accepted for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    blind = li.classify(docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", -F.col("doc_id")), model)
    assert {r.text: r.lang_pred for r in got}.items() <= {r.text: r.lang_pred for r in blind.collect()}.items()


def test_unlearned_language_and_random_letters_are_rejected(spark):
    rng, unlearned = random.Random(11), "zhok wyr pfim gulv qadj".split()
    rows = [(10_000 + i, " ".join("".join(rng.choice(unlearned) for _ in range(rng.randint(1, 3))) for _ in range(60)), None) for i in range(100)]
    rows += [(20_000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(600)), None) for i in range(100)]
    docs = spark.createDataFrame(corpus(1500, 1) + rows, "doc_id long, text string, lang string")
    got = li.classify(docs, li.train(docs, F.col("doc_id") % 4 != 2)).where("lang is null or doc_id % 4 = 2").collect()

    def accepted(of):
        return np.mean([r.accepted for r in got if of(r)])
    assert accepted(lambda r: r.lang is not None) > 0.98
    assert accepted(lambda r: 10_000 <= r.doc_id < 20_000) < 0.1
    assert accepted(lambda r: r.doc_id >= 20_000) < 0.1


def test_odd_rows(spark, odd_docs, no_docs):
    rows = spark.createDataFrame([(10_000 + i, t, n, None, None, None, None) for i, t, n in corpus(300, 2)], odd_docs.schema)
    model = li.train(odd_docs.union(rows), F.lit(True))
    clash = odd_docs.withColumns({"score": F.lit("mine"), "accepted": F.lit(3)})
    got = li.classify(clash, model)
    assert got.columns == [*odd_docs.columns, "lang_pred", "score", "accepted"] and got.count() == odd_docs.count()
    for r in got.collect():
        empty = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == empty
        if empty:
            assert r.score == 0 and not r.accepted
    assert li.classify(no_docs, model).count() == 0
    none = li.train(no_docs, F.lit(True))
    assert {r.lang_pred for r in li.classify(odd_docs, none).collect()} == {"und"}


def test_long_text_is_read_whole():
    model = li.Model(["x", "y"], np.random.default_rng(0).normal(size=(li.BUCKETS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    text = " ".join(w for _, w, _ in corpus(300, 3)) + " 12--" + "é" * 4000 + "! end"
    whole = li.scores([text, "ka"], model)
    for chunk in (1, 7, 1000):  # wherever it is cut, nothing is lost or counted twice
        assert np.abs(whole - li.scores([text, "ka"], model, chunk=chunk)).max() < 1e-12
        data = li.prepared(text)
        assert sorted(np.concatenate([li.features(p)[1] for p in li.pieces(data, chunk)])) == sorted(li.features(data)[1])
    assert np.abs(whole[0] - li.scores([text[:1000]], model)[0]).max() > 1e-4


def test_equals_plain_scorer(spark):
    """Scores against the average of the features' rows of the table, written out."""
    rows = corpus(400, 5)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, verdict string, _has_letter int")
    model = li.train(docs, F.lit(True))
    got = li.classify(docs, model)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and "_has_letter" in got.columns
    for r in got.collect():
        f = li.features(li.prepared(r.text))[1]
        z = (model.table[f].astype(np.float64).mean(axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-9 and r.accepted == (r.score >= model.reject_below) or abs(p.max() - model.reject_below) < 1e-9
