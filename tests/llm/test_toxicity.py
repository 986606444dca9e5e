"""Toxicity: features by hand, held-out accuracy on planted and on given labels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import toxicity
from textloom.llm.queries import op13_toxicity

LEXICON = {"idiot": 0.9, "moron": 0.6}


def _features(text):
    return dict(zip(toxicity.FEATURES, toxicity._Words(LEXICON).features(text), strict=True))


def test_features_by_hand():
    plain = _features("You are an idiot, moron!")
    assert plain["density"] == pytest.approx(1.5 / 5) and plain["distinct"] == 2 and plain["strongest"] == 0.9
    assert plain["hits"] == pytest.approx(math.log1p(2)) and plain["disguised"] == 0 and plain["second"] == 0.2
    assert plain["nearness"] == pytest.approx((1 / 4 + 1 / 5) / 2)  # three and four words from "You"
    assert plain["calls"] == 0.2 and plain["marks"] == pytest.approx(2 / 20) and plain["upper"] == pytest.approx(1 / 18)
    for said in ("1d10t", "i*d*i*o*t", "idiiiiot", "m0r0n!", "ID1OT"):
        found = _features(f"what an {said} here")
        assert found["strongest"] >= 0.6 and found["disguised"] == 0.25, said
    spaced = _features("such a big i d i o t here")
    assert spaced["strongest"] == 0.9 and spaced["spaced"] == pytest.approx(5 / 9)
    assert _features("idiot###")["strongest"] == 0.9 and _features("idiot|x")["hits"] > 0
    assert _features("STOP NOW ok")["shouted"] == pytest.approx(2 / 3)
    assert _features("") == dict.fromkeys(toxicity.FEATURES, 0.0) == _features(" \n")
    assert _features("x" * 500_000 + " idiot" * 1000)["distinct"] == 1


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 10)
    words = toxicity._Words(LEXICON)
    texts = [" ".join(f"w{i}{j}" for j in range(9)) + " idiot" for i in range(20)]
    assert [words.features(t) for t in texts] == [toxicity._Words(LEXICON).features(t) for t in texts]


def _planted(n, seed):
    rng = random.Random(seed)
    pool, bad = [f"wort{i}" for i in range(400)], ["garbage", "fool", "vermin", "creep"]
    for i in range(n):
        words = rng.choices(pool, k=rng.randint(15, 60))
        toxic = i % 7 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        yield i, " ".join(words), int(toxic)


def test_planted_texts(spark):
    rows = list(_planted(900, 3))
    copied = "one passage that stands in many toxic texts and means nothing"
    rows = [(i, f"{t} {copied}" if y and i % 2 else t, y) for i, t, y in rows]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert set(model.lexicon) >= {"garbage", "fool", "vermin", "creep"}
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    unseen = [(scores[i], y) for i, _, y in rows if i % 3 == 0]
    assert sum((s >= 0.7) == y for s, y in unseen) / len(unseen) >= 0.98 and all(0 <= s <= 1 for s in scores.values())
    more = [(1, None, 1), (2, "", 1), (3, " ", 1), (3, " ", 1), (None, "a fool and a creep, you vermin", 2), (5, "a fool " * 100_000, 2)]
    found = toxicity.score_toxicity(spark.createDataFrame(more, "doc_id long, text string, x int"), model).collect()
    assert len(found) == 6 and [r.score >= 0.7 for r in found] == [False] * 4 + [True] * 2
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []


def test_few_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    fit = lambda rows: toxicity.fit_toxicity(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    for rows, share in (([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (1, 1), (None, 1), (2, None), (3, 0)], 0.0)):
        model = fit(rows)
        assert model.trees is None and {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {share}
    model = fit([(i, int(i == 1)) for i in range(8)])  # no fold can be left out
    assert model.trees is not None and all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, model).collect())


def test_given_labels(spark):
    folder = "/root/testdata/sf0.1"
    found = op13_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    right, clean, n = found.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))), F.count("*")).first()
    assert n > 1000 and right >= 0.98 and clean <= 0.01
