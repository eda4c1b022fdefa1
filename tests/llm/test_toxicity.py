import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ehrseq.llm import toxicity as tox
from ehrseq.llm.queries import toxicity as query
from ehrseq.llm.toxicity import Features, fit, fit_toxicity, risk, samples, score_toxicity, word_features

from .odd import odd_documents

LABELS = "doc_id bigint, toxic int, quality int"
BAD = ["flurgol", "zanktrop", "mirbesk"]


def texts(seed, n, share=0.15):
    rng = random.Random(seed)
    first, middle, last = "ban tor lis mek sul gra wen pho".split(), "ta ro ni lu se ko di ma".split(), "en ior ust ely omi a".split()
    words = [a + b + c for a in first for b in middle for c in last]
    found = []
    for i in range(n):
        said, bad = rng.choices(words, k=rng.randint(5, 60)), rng.random() < share
        if bad:
            said.insert(rng.randrange(len(said)), rng.choice(BAD) + rng.choice(["", "en", "ity"]))
        found.append((i, " ".join(said).capitalize(), bad))
    return found


def plain_risk(weights, bias, toxic, unlabelled, prior):
    """The two terms written out document by document."""
    loss = lambda held, sign: 1 / (1 + np.exp(sign * (sum(weights[f] for f in held) + bias)))
    mean = lambda rows, sign: sum(loss(r, sign) for r in rows) / len(rows)
    return mean(toxic, 1), mean(unlabelled, -1) - prior * mean(toxic, -1)


def test_risk_and_gradients():
    rng = np.random.default_rng(1)
    rows = lambda n: [sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist()) for _ in range(n)]
    toxic, unlabelled, prior = rows(9), rows(14), 0.3
    weights, bias = rng.normal(size=6), np.array(0.4)
    sets = [(tox._flat(r), len(r)) for r in (toxic, unlabelled)]
    plus, rest, rise, other = risk(weights, bias, *sets, prior)
    assert np.allclose((plus, rest), plain_risk(weights, bias, toxic, unlabelled, prior))
    h = 1e-6
    for n in range(7):
        up, down = ((weights + s * h * (np.arange(6) == n), bias + s * h * (n == 6)) for s in (1, -1))
        a, b = (np.array(plain_risk(*x, toxic, unlabelled, prior)) for x in (up, down))
        slope = (a - b) / (2 * h) * (prior, 1)
        assert np.allclose(slope, [np.append(rise[0], rise[1])[n], np.append(other[0], other[1])[n]], atol=1e-7)


def test_fit_lowers_the_risk_and_stays_above_memory():
    toxic, unlabelled, prior = [[0, 1], [0], [0, 2]] * 20, [[0]] * 20 + [[1], [2], [], [1, 2]] * 45, 0.1
    weights, bias = fit(toxic, unlabelled, 3, prior)
    plus, rest = plain_risk(weights, bias, toxic, unlabelled, prior)
    assert prior * plus + max(0, rest) < 0.5 * prior
    # The toxic among the unlabelled are called toxic.
    assert weights[0] + bias > 1 and bias < -1 and weights[1] + weights[2] + bias < -1


def test_features():
    assert Features()("Abc abcde, ABC 12 é") == sorted(word_features("abc") | word_features("abcde") | word_features("é"))
    known = np.array(sorted(word_features("abcde")))
    assert Features(known)("xx abcde abc") == [0, 1, 2] and Features(known)(None) == Features(known)("abc 1") == []
    # A beginning is not the word.
    assert not word_features("abcd") >= word_features("abcde") and len(word_features("abcd") & word_features("abcde")) == 1


def made(spark, rows, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, int(bad), 1) for i, _, bad in rows if labelled(i)], LABELS)


def test_finds_unlabelled_toxic_texts(spark):
    rows = texts(2, 1500)
    # A third of all rows are copies of one toxic text, most of them unlabelled.
    rows += [(5000 + n, rows[0][1] + " flurgol", True) for n in range(750)]
    docs, labels = made(spark, rows, lambda i: i % 3 == 0)
    model = fit_toxicity(docs, labels, F.col("doc_id") % 2 == 0)
    found = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    unseen = [(found[i].predicted, bad) for i, _, bad in rows if i % 2 == 1]
    assert sum(p for p, bad in unseen if bad) >= 0.95 * sum(bad for _, bad in unseen)
    assert sum(p for p, bad in unseen if not bad) <= 0.01 * len(unseen)


def test_samples_are_bounded_and_never_read_held_out_labels(spark, monkeypatch):
    docs, labels = made(spark, texts(3, 300) + [(7, f"copy {n}", True) for n in range(200)], lambda i: True)
    learn = F.col("doc_id") % 2 == 0
    count = lambda: {r.toxic: r["count"] for r in samples(docs, labels, learn, "doc_id", "text", "toxic").groupBy("toxic").count().collect()}
    whole = count()
    assert 140 < whole[False] <= 150 and 5 < whole[True] < 50
    monkeypatch.setattr(tox, "TOXIC_SAMPLE", 4)
    monkeypatch.setattr(tox, "UNLABELLED_SAMPLE", 20)
    assert count() == {True: 4, False: 20}
    flipped = labels.withColumn("toxic", F.when(learn, F.col("toxic")).otherwise(1 - F.col("toxic")))
    one, other = (fit_toxicity(docs, given, learn) for given in (labels, flipped))
    assert (one.known == other.known).all() and (one.weights == other.weights).all() and (one.biases == other.biases).all()


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(5, 1, 1), (5, 0, 1), (4, 0, None), (None, 1, 1), (9, None, 0), (77, 1, 0)], LABELS)
    scored = score_toxicity(docs, fit_toxicity(docs, labels, F.lit(True))).collect()
    assert len(scored) == docs.count()
    by_text = {r.doc_id: r.score for r in scored}
    # Null, empty and blank texts alike.
    assert by_text[1] == by_text[2] == by_text[3]
    with pytest.raises(ValueError):
        score_toxicity(docs, fit_toxicity(docs, labels, F.lit(True)), id_column="score")


def test_no_labels_and_no_rows(spark):
    docs, none = odd_documents(spark), spark.createDataFrame([], LABELS)
    model = fit_toxicity(docs, none, F.lit(True))
    assert {(round(r.score, 6), r.predicted) for r in score_toxicity(docs, model).collect()} == {(tox.PRIOR, 0)}
    empty = docs.limit(0)
    assert score_toxicity(empty, fit_toxicity(empty, none, F.lit(True))).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    scored = query(spark, folder)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    known = scored.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    caught, toxic = sum(r.predicted for r in known if r.toxic), sum(r.toxic for r in known)
    assert caught >= 0.7 * toxic
    assert sum(r.predicted for r in known if not r.toxic) <= 0.01 * (len(known) - toxic)
