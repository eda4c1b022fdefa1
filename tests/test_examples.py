import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ehrseq.functions.draws import uniform
from ehrseq.operators import baseline, examples
from ehrseq.operators.sequences import explode_sequences
from ehrseq.operators.vocabulary import (
    decode,
    encode,
    fit_vocabulary,
    in_training_split,
    list_vocabulary,
    split_by_person,
    vocabulary_facts,
)
from ehrseq.plans import catalog
from ehrseq.plans.process import process_tables
from ehrseq.settings import ExampleSettings, MappingSettings
from ehrseq.sources import trial
from ehrseq.staging import Staging
from tests.conftest import SMALL, rows

# Three visits, years apart at the end.
SEQUENCE = {
    "person_id": 6,
    "observation_period_id": 60,
    "concept_ids": ["VS", "55", "VE", "M2", "VS", "31", "55", "VE", "LT", "VS", "77", "VE"],
    "visit_segments": [2, 2, 2, 0, 1, 1, 1, 1, 0, 2, 2, 2],
    "orders": list(range(12)),
    "dates": [1500] * 3 + [0] + [1510] * 4 + [0] + [1600] * 3,
    "ages": [480] * 3 + [-1] + [482] * 4 + [-1] + [503] * 3,
    "visit_concept_orders": [1] * 3 + [2] * 5 + [3] * 4,
    "num_of_concepts": 12,
    "num_of_visits": 3,
    "visit_concept_ids": ["9201"] * 3 + ["0"] + ["9203"] * 4 + ["0"] + ["9201"] * 3,
}
SCHEMA = (
    "person_id bigint, observation_period_id bigint, concept_ids array<string>, visit_segments array<int>, "
    "orders array<int>, dates array<int>, ages array<int>, visit_concept_orders array<int>, num_of_concepts bigint, "
    "num_of_visits bigint, visit_concept_ids array<string>"
)


@pytest.fixture(scope="module")
def tokens(spark):
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return explode_sequences(spark.createDataFrame([tuple(SEQUENCE[n] for n in names)], SCHEMA))


@pytest.fixture(scope="module")
def words(tokens):
    return Staging(tokens.sparkSession)(fit_vocabulary(tokens, "concept_ids"), "words")


@pytest.fixture(scope="module")
def visit_words(tokens):
    return fit_vocabulary(tokens, "visit_concept_ids")


@pytest.fixture(scope="module")
def many(spark):
    staged = Staging(spark)(process_tables(trial.cdm_tables(spark, SMALL), MappingSettings()).tokens, "tokens")
    return staged


@pytest.fixture(scope="module")
def many_words(many):
    return Staging(many.sparkSession)(fit_vocabulary(many, "concept_ids"), "words")


def build(tokens, words, visit_words, **options):
    settings = ExampleSettings(**{"max_length": 16, "truncate": "tail", **options})
    return examples.build_examples(tokens, words, visit_words, settings)


def test_vocabulary(tokens, words, spark):
    ids = {r.token: r.token_id for r in words.collect()}
    words_in_order = ["[PAD]", "[MASK]", "[OOV]", "[CLS]", "31", "55", "77", "LT", "M2", "VE", "VS"]
    assert ids == {word: n for n, word in enumerate(words_in_order)}
    facts = vocabulary_facts(words).first()
    assert (facts.vocabulary_size, facts.first_token_id, facts.last_token_id) == (11, 4, 10)
    assert [r.token for r in list_vocabulary(tokens, "concept_ids").collect()] == words_in_order[4:]
    unknown = spark.createDataFrame([("55",), ("nowhere",), (None,)], "t string")
    encoded = encode(unknown, "t", words, "id")
    assert rows(encoded, "t", "id") == [("55", 5), ("nowhere", 2), (None, 2)]
    more = spark.createDataFrame([(4,), (77,)], "id bigint")
    assert rows(decode(more, "id", words, "t"), "id", "t") == [(4, "31"), (77, None)]


def test_inputs(tokens, words, visit_words):
    row = build(tokens, words, visit_words).first()
    assert row.token_ids == [3, 10, 5, 9, 8, 10, 4, 5, 9, 7, 10, 6, 9, 0, 0, 0]
    assert row.visit_concept_orders == [0, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3, 3, 15, 15, 15]
    assert row.padding_mask == [0.0] * 13 + [-math.inf] * 3
    assert row.visit_segments == [0, 2, 2, 2, 0, 1, 1, 1, 1, 0, 2, 2, 2, 0, 0, 0]
    assert row.ages == [0.0] + [480.0] * 3 + [-1.0] + [482.0] * 4 + [-1.0] + [503.0] * 3 + [0.0] * 3
    assert row.visit_token_ids == [3, 5, 5, 5, 4, 6, 6, 6, 6, 4, 5, 5, 5, 0, 0, 0]


def test_tail_truncation(tokens, words, visit_words):
    row = build(tokens, words, visit_words, max_length=7).first()
    assert row.token_ids == [3, 5, 9, 7, 10, 6, 9]
    assert row.visit_concept_orders == [0, 1, 1, 2, 2, 2, 2]
    assert row.padding_mask == [0.0] * 7


def test_next_token(tokens, words, visit_words):
    row = build(tokens, words, visit_words, next_token=True).first()
    assert row.token_ids == [3, 10, 5, 9, 8, 10, 4, 5, 9, 7, 10, 6, 0, 0, 0, 0]
    assert row.next_token_ids == [3, 5, 9, 8, 10, 4, 5, 9, 7, 10, 6, 9, 0, 0, 0, 0]
    short = build(tokens, words, visit_words, next_token=True, max_length=4).first()
    assert (short.token_ids, short.next_token_ids) == ([3, 7, 10, 6], [3, 10, 6, 9])


def test_next_visit(tokens, words, visit_words):
    row = build(tokens, words, visit_words, next_visit=True).first()
    assert row.token_ids == [3, 10, 5, 9, 8, 10, 4, 5] + [0] * 8
    assert row.next_visit_token_set == [6, 7, 9, 10]
    dense = build(tokens, words, visit_words, next_visit=True, dense_next_visit=True).first()
    assert dense.next_visit_token_set == [0.0] * 6 + [1.0, 1.0, 0.0, 1.0, 1.0]
    single = tokens.where("visit_concept_orders = 1").withColumn("last_visit_start", F.lit(0))
    assert build(single, words, visit_words, next_visit=True).count() == 0


def test_features_can_be_left_out(tokens, words, visit_words):
    few = build(tokens, words, visit_words, visit_token_ids=False, ages=False, dates=False, segments=False)
    assert few.columns == ["person_id", "observation_period_id", "token_ids", "visit_concept_orders", "padding_mask"]


def test_random_truncation_stays_inside(many, many_words):
    settings = ExampleSettings(max_length=16, truncate="random", seed=1)
    kept = examples.truncate(many, settings).groupBy("observation_period_id").agg(
        F.count("*").alias("n"), F.min("orders").alias("lo"), F.max("orders").alias("hi"), F.max("sequence_length").alias("all")
    )
    starts = set()
    for r in kept.collect():
        assert r.n == min(15, r["all"]) and r.hi - r.lo + 1 == r.n and r.hi < r["all"]
        starts.add(r.lo)
    assert len(starts) > 10


def test_masking_rates(many, many_words):
    visit_words = fit_vocabulary(many, "visit_concept_ids")
    long = build(many, many_words, visit_words, max_length=128, mask_concepts=True, mask_visits=True, seed=5).collect()
    ids = {r.token_id for r in many_words.where("token_id >= 4").collect()}
    chosen = total = masked = kept = visits = 0
    for r in long:
        for shown, true, free, visit_free in zip(
            r.masked_token_ids, r.token_ids, r.masked_token_mask, r.masked_visit_token_mask
        ):
            if true in (0, 3):
                assert shown == true and free and visit_free
                continue
            total += 1
            visits += not visit_free
            if free:
                assert shown == true
                continue
            chosen += 1
            masked += shown == 1
            kept += shown == true
            assert shown == 1 or shown in ids
    assert 0.13 < chosen / total < 0.17
    assert 0.74 < masked / chosen < 0.86 and 0.05 < kept / chosen < 0.16
    assert 0.47 < visits / total < 0.53


def test_one_mask_per_visit(many, many_words):
    visit_words = fit_vocabulary(many, "visit_concept_ids")
    options = dict(max_length=128, mask_concepts=True, seed=5)
    one = build(many, many_words, visit_words, one_mask_per_visit=True, **options).collect()
    free = {r.observation_period_id: r.masked_token_mask for r in build(many, many_words, visit_words, **options).collect()}
    for r in one:
        seen = set()
        for i, visit in enumerate(r.visit_concept_orders):
            wanted = not free[r.observation_period_id][i] and visit not in seen
            assert r.masked_token_mask[i] == (not wanted)
            if wanted:
                seen.add(visit)


def test_impossible_combinations():
    for options in (
        {"truncate": "head"},
        {"next_token": True, "next_visit": True},
        {"next_token": True, "label": True},
        {"mask_concepts": True, "token_ids": False},
        {"mask_visits": True, "visit_token_ids": False},
    ):
        with pytest.raises(ValueError):
            ExampleSettings(**options)
    trained = ExampleSettings(mask_concepts=True, one_mask_per_visit=True, mask_visits=True, label=True)
    assert trained.for_evaluation() == ExampleSettings(label=True)


def test_split_keeps_persons_on_one_side(many):
    train, test = split_by_person(many, 0.7, seed=2)
    a, b = ({r[0] for r in side.select("person_id").distinct().collect()} for side in (train, test))
    assert not a & b and train.count() + test.count() == many.count()
    assert 0.55 < len(a) / (len(a) + len(b)) < 0.85


def test_draws_are_even_and_independent(spark):
    frame = spark.range(20000).select(uniform(1, "a", "id").alias("a"), uniform(1, "b", "id").alias("b"))
    row = frame.agg(F.avg("a"), F.min("a"), F.max("a"), F.corr("a", "b")).first()
    assert abs(row[0] - 0.5) < 0.01 and row[1] >= 0 and row[2] < 1 and abs(row[3]) < 0.03


def test_training_cap_nests(many):
    periods = many.select("person_id", "observation_period_id").distinct()
    small, large = ({tuple(r) for r in examples.cap_training_set(periods, n, 3).collect()} for n in (20, 60))
    assert len(small) == 20 and len(large) == 60 and small < large
    assert examples.cap_training_set(periods, 10**6, 3).count() == periods.count()


def test_baseline(spark, tokens, words, visit_words):
    built = build(tokens, words, visit_words)
    assert baseline.token_presence(built).first().present == [0, *range(3, 11)]
    weights = spark.createDataFrame([(3, 0.5), (5, -1.0), (7, 0.25)], "token_id bigint, weight double")
    score = baseline.baseline_scores(built, weights, 0.1).first().prediction
    assert score == pytest.approx(1 / (1 + math.exp(0.15)))
    vector = baseline.presence_vectors(built.withColumn("finetune_label", F.lit(1.0)), 11).first().features
    assert list(vector.toArray()) == [1, 0, 0] + [1] * 8


def test_fitted_weights_score_like_the_model(spark, many, many_words):
    visit_words = fit_vocabulary(many, "visit_concept_ids")
    odd = (F.col("person_id") % 2).alias("finetune_label")
    built = build(many, many_words, visit_words, max_length=32).select("*", odd)
    size = many_words.count()
    model = baseline.fit_baseline(built, size, max_iter=5)
    scored = baseline.baseline_scores(built, baseline.model_weights(model, spark), model.intercept)
    ours = {r.observation_period_id: r.prediction for r in scored.collect()}
    theirs = model.transform(baseline.presence_vectors(built, size)).select("observation_period_id", "probability")
    for r in theirs.collect():
        assert ours[r.observation_period_id] == pytest.approx(float(r.probability[1]))


def test_baseline_is_fitted_on_all_training_examples(spark, monkeypatch):
    """However many there are; it once stopped at 200,000."""
    person, none = F.col("id"), F.lit(0)
    labelled = spark.range(260_000).select(
        person.alias("person_id"), (person * 10 + 1).alias("observation_period_id"), none.alias("orders"), F.lit(1).alias("sequence_length"),
        none.alias("last_visit_start"), F.when(person % 3 == 0, "a").otherwise("b").alias("concept_ids"), F.lit("9202").alias("visit_concept_ids"),
        *[none.alias(name) for name in ("visit_segments", "visit_concept_orders", "ages", "dates")], (person % 2 == 0).alias("label"),
    )
    words, visit_words = (fit_vocabulary(labelled, name) for name in ("concept_ids", "visit_concept_ids"))
    run = SimpleNamespace(spark=spark, labelled_tokens=labelled, vocabulary=words, visit_vocabulary=visit_words, stage=Staging(spark))
    monkeypatch.setattr(catalog, "trial_run", lambda *_: run)
    fit, fitted = baseline.fit_baseline, []

    def seen(*given, **options):
        fitted.append(fit(*given, **options))
        return fitted[-1]

    monkeypatch.setattr(baseline, "fit_baseline", seen)
    result = catalog.QUERIES["baseline_fit"](spark, "none")
    training = labelled.where(in_training_split(catalog.TRAIN_FRACTION, catalog.SEED)).count()
    assert fitted[0].summary.predictions.count() == training > 200_000
    assert result.agg(F.count("*"), F.sum("same")).first() == (260_000, 260_000)


def _adam(rows, labels, size, settings):
    """The same steps in numpy; the last weight is the bias."""
    x = np.zeros((len(rows), size + 1))
    for n, present in enumerate(rows):
        x[n, list(present)] = 1
    x[:, size] = 1
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for n in range(1, settings.steps + 1):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - labels) / len(rows) + settings.weight_decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - settings.learning_rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
    return w


def test_gradient_fit_equals_numpy(spark):
    generator = random.Random(4)
    size, made = 30, [(n, sorted(generator.sample(range(25), 6)) + [3, 3], generator.randrange(2)) for n in range(200)]
    given = [(n, n, ids, float(y)) for n, ids, y in made] + [(900, 900, [1], None)]
    examples_ = spark.createDataFrame(given, "person_id bigint, observation_period_id bigint, token_ids array<bigint>, finetune_label float")
    vocabulary = spark.range(size).select(F.col("id").alias("token_id"), F.col("id").cast("string").alias("token"))
    for decay in (0.0, 0.1):
        settings = baseline.AdamSettings(steps=6, learning_rate=0.1, weight_decay=decay)
        fitted = {r.token_id: r.weight for r in baseline.fit_by_gradient(examples_, vocabulary, settings).collect()}
        expected = _adam([ids for _, ids, _ in made], np.array([y for *_, y in made]), size, settings)
        assert sorted(fitted) == list(range(-1, size))
        assert np.abs(np.array([fitted[n] for n in (*range(size), -1)]) - expected).max() < 1e-9
    # A token no example has stays at zero, and without examples all do.
    assert fitted[29] == 0
    none = baseline.fit_by_gradient(examples_.limit(0), vocabulary, settings).collect()
    assert len(none) == size + 1 and {r.weight for r in none} == {0.0}


def test_vectors_are_built_from_places(spark):
    given = spark.createDataFrame([(1, [7, 3, 3, 0]), (2, []), (3, [9, 10, -1])], "i int, token_ids array<bigint>")
    built = baseline.presence_vectors(given.withColumn("finetune_label", F.lit(1)), 10).orderBy("i").collect()
    assert [(r.features.size, r.features.indices.tolist(), set(r.features.values)) for r in built] == [(10, [0, 3, 7], {1.0}), (10, [], set()), (10, [9], {1.0})]
