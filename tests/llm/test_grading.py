import zlib

import numpy as np
from pyspark.sql import functions as F

from ehrseq.llm import grading
from ehrseq.llm.grading import GradeModel, features, fit, fit_grades, grade_documents, grade_of, rated_features

from .odd import TEXTS, odd_documents


def synthetic(n=600):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        grade = int(rng.integers(0, 4))
        # Feature 1 speaks for low grades, 2 for high ones; 3 to 60 are noise.
        marks = [f for f, p in ((1, (3 - grade) / 3), (2, grade / 3)) if rng.random() < p]
        rows.append((grade, sorted({*marks, *rng.integers(3, 60, 5).tolist()})))
    return rows


def test_grades_are_ordered_and_noise_gets_no_weight():
    model = fit(synthetic(), 4)
    assert model.weights[1] < -0.5 and model.weights[2] > 0.5
    assert np.count_nonzero(model.weights[3:]) <= 2
    assert (np.diff(model.thresholds) > 0).all()
    expected = [model.probabilities(s) @ np.arange(4) for s in (-3, 0, 3)]
    assert expected == sorted(expected)
    assert all(abs(model.probabilities(s).sum() - 1) < 1e-9 for s in (-50, 0, 50))


def test_fit_beats_the_margins():
    rows = synthetic()
    model = fit(rows[:400], 4)
    score = [float(model.weights[f].sum()) for _, f in rows[400:]]
    guess = np.array([model.probabilities(s).argmax() for s in score])
    grades = np.array([g for g, _ in rows[400:]])
    assert np.abs(guess - grades).mean() < 0.9 * np.abs(grades - np.median(grades)).mean()


def test_held_out_labels(spark):
    """Fitted on three quarters of the labels; toxic and poor documents of the rest go, clean ones stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    held = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(4)) == 0
    model = fit_grades(docs, ratings.where(~held), grades=3)
    graded = grade_documents(docs, model, good=2).join(ratings.where(held), "doc_id").collect()
    kept = {g: np.mean([r.kept for r in graded if r.grade == g]) for g in range(3)}
    assert kept[2] > 0.93 and kept[1] < 0.15 and kept[0] < 0.15
    means = {g: np.mean([r.expected_grade for r in graded if r.grade == g]) for g in range(3)}
    assert means[0] < means[1] < means[2]


def test_sample_is_bounded_and_rated_twice_counts_low(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] * 3, "doc_id bigint, text string")
    ratings = spark.createDataFrame([(i, g) for i in range(50) for g in (2, 1)] + [(None, 0), (3, None)], "doc_id bigint, grade int")
    rows = rated_features(docs, ratings, sample=20).collect()
    assert len(rows) == 20 and {r.grade for r in rows} == {1}


def test_grade_of(spark):
    rows = spark.createDataFrame([(1, 0), (0, 0), (1, 1), (0, 1), (None, None)], "q int, t int")
    assert [r.g for r in rows.select(grade_of(F.col("q"), F.col("t")).alias("g")).collect()] == [2, 1, 0, 0, None]


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    model = GradeModel(np.zeros(1 << 18, np.float32), np.array([-1.0, 1.0]))
    out = grade_documents(odd, model, good=2).collect()
    assert len(out) == len(TEXTS) and len({r.tail_probability for r in out}) == 1
    assert features(None) == features("") == []
    nothing = spark.createDataFrame([], "doc_id bigint, grade int")
    assert grade_documents(odd.limit(0), fit_grades(odd, nothing, grades=3), good=2).collect() == []


def plain_loss(weights, thresholds, rows, grades, penalty):
    """The penalized likelihood written out row by row; grades weigh alike."""
    counts = [sum(g == j for g, _ in rows) for j in range(grades)]
    seen = sum(c > 0 for c in counts)
    loss = 0.5 * penalty * sum(w * w for w in weights.values())
    for grade, held in rows:
        score = sum(weights[f] for f in held)
        below = [0.0, *(1 / (1 + np.exp(score - t)) for t in thresholds), 1.0]
        loss -= np.log(below[grade + 1] - below[grade]) / counts[grade] / seen
    return loss


def test_fit_is_at_the_least_of_the_plain_loss():
    rng, penalty = np.random.default_rng(6), 1e-2
    rows = []
    for _ in range(120):
        held = sorted(rng.choice(8, rng.integers(1, 5), replace=False).tolist())
        rows.append((int(np.digitize(sum(h - 3.5 for h in held) + rng.normal(0, 4), [-4, 4])), held))
    model = fit(rows, 3, rounds=4000, penalty=penalty, min_errors=-1.0)
    weights, thresholds = {n: float(model.weights[n]) for n in range(8)}, [float(t) for t in model.thresholds]
    assert thresholds == sorted(thresholds) and not model.weights[8:].any()
    least, h = plain_loss(weights, thresholds, rows, 3, penalty), 1e-4
    for n in range(10):
        ends = []
        for step in (h, -h):
            w = {k: v + step * (k == n) for k, v in weights.items()}
            t = [v + step * (8 + k == n) for k, v in enumerate(thresholds)]
            ends.append(plain_loss(w, t, rows, 3, penalty))
        # Flat there, and higher a step away.
        assert abs(ends[0] - ends[1]) / (2 * h) < 1e-3
        assert plain_loss({k: v + 0.3 * (k == n) for k, v in weights.items()}, [v + 0.3 * (8 + k == n) for k, v in enumerate(thresholds)], rows, 3, penalty) > least
    # The model's probabilities are those of the plain cumulative link.
    p = model.probabilities(0.7)
    plain = [1 / (1 + np.exp(0.7 - t)) for t in thresholds]
    assert np.allclose(p, [plain[0], plain[1] - plain[0], 1 - plain[1]])


def test_features_are_those_of_the_plain_rules():
    text = "Well, well! A word " + "again " * 9 + "x1 y_z é " + "filler " * 40
    tokens, now = [], ""
    kind = lambda c: "letter" if c.isalpha() else "mark" if not (c.isalnum() or c.isspace() or c == "_") else ""
    for c in text.replace("W", "w").replace("A", "a") + " ":
        if now and kind(c) != kind(now[-1]):
            tokens.append(now)
            now = ""
        now = now + c if kind(c) else ""
    names = set(tokens)
    names |= {f"{t} {min(tokens.count(t).bit_length(), 8)}" for t in set(tokens) if tokens.count(t) >= 8}
    names |= {f" varied {10 * len(set(tokens)) // len(tokens)}"}
    assert features(text) == sorted({zlib.crc32(n.encode()) % grading.BUCKETS for n in names})
    assert features(None) == features(" 12 _ ") == []
