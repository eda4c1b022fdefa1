import numpy
import pytest
from pyspark.sql import functions as F

from ehrseq.operators import cohort, quality
from ehrseq.operators.numbering import busy_persons
from ehrseq.staging import Staging
from tests.conftest import day, rows


@pytest.mark.parametrize("n,k", [(100, 10), (11, 5), (6, 2), (7, 1), (4, 9), (1, 3), (20011, 37)])
def test_concepts_are_evenly_spread(spark, n, k):
    concepts = spark.range(n).select((F.col("id") * 7).alias("concept_id"))
    expected = sorted({int(i) * 7 for i in numpy.round(numpy.linspace(0, n - 1, k))})
    assert sorted(r[0] for r in cohort.choose_concepts(concepts, k).collect()) == expected


@pytest.fixture(scope="module")
def periods(spark):
    return spark.createDataFrame(
        [(1, 10, day("2000-01-01"), day("2000-12-31")), (2, 20, day("2000-01-01"), day("2000-06-30"))],
        "person_id bigint, observation_period_id bigint, observation_period_start_date date, "
        "observation_period_end_date date",
    )


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(
        [
            (1, 5, day("2000-12-01")),
            (1, 5, day("2000-12-31")),
            (1, 6, day("2000-12-30")),
            (1, 7, day("2001-01-01")),
            (2, 6, day("2000-06-20")),
        ],
        "person_id bigint, concept_id bigint, start_date date",
    )


def test_window_labels_and_history(spark, periods, events):
    concepts = spark.createDataFrame([(5,), (6,), (7,)], "concept_id bigint")
    busy = busy_persons([events], Staging(spark), 2)
    for cut in (None, busy):
        labels = cohort.window_labels(events, periods, concepts, 10, cut)
        assert rows(labels) == [
            (1, 10, 5, True),
            (1, 10, 6, True),
            (1, 10, 7, False),
            (2, 20, 5, False),
            (2, 20, 6, False),
            (2, 20, 7, False),
        ]
        past = cohort.history(events, "start_date", periods, 10, cut)
        assert rows(past, "person_id", "concept_id", "start_date") == [
            (1, 5, day("2000-12-01")),
            (2, 6, day("2000-06-20")),
        ]
    assert quality.label_prevalence(labels).first()[0] == pytest.approx(100 / 3)
    assert rows(quality.label_counts(labels)) == [(False, 4), (True, 2)]


def test_sparse_labels_say_what_dense_ones_do(spark, periods, events):
    stage = Staging(spark)
    given = spark.createDataFrame([(c,) for c in (5, 6, 7, 8, 9, 6, None)], "concept_id bigint")
    listed = cohort.list_concepts(given, stage)
    positives = cohort.positive_labels(events, periods, listed, 10)
    dense = rows(cohort.window_labels(events, periods, given, 10))
    assert len(dense) == 2 * 5 and rows(positives) == [r[:3] for r in dense if r[3]]
    # Blocks of any size, more of them than concepts in one, and none at all.
    for per_block in (1, 2, 5):
        assert rows(cohort.window_labels(events, periods, given, 10, stage=stage, concepts_per_block=per_block)) == dense
    assert rows(cohort.window_labels(events, periods, given.limit(0), 10)) == []
    sparse = quality.sparse_label_prevalence(positives, periods, listed).first()[0]
    assert sparse == pytest.approx(quality.label_prevalence(cohort.window_labels(events, periods, given, 10)).first()[0])


def test_many_concepts_are_not_refused(spark, periods, events):
    """Prevalence never lays out periods by concepts; labels do, in blocks."""
    stage = Staging(spark)
    many = cohort.list_concepts(spark.range(30_000).select(F.col("id").alias("concept_id")), stage)
    assert cohort.window_labels(events, periods, many, 10, stage=stage).where("label").count() == 2
    sparse = quality.sparse_label_prevalence(cohort.positive_labels(events, periods, many, 10), periods, many)
    assert sparse.first()[0] == pytest.approx(100 * 2 / 60_000)
    assert "Generate" not in sparse._jdf.queryExecution().optimizedPlan().toString()


def test_visit_types_and_gender(spark):
    events = spark.createDataFrame(
        [(1, 1, 5), (1, 1, 6), (1, 2, 6)], "visit_person_id bigint, visit_seq bigint, concept_id bigint"
    )
    assert rows(cohort.visit_types(events, F.col("concept_id") == 5)) == [(1, 1, 9203), (1, 2, 9201)]
    state = spark.createDataFrame([(0,), (1,)], "s int")
    assert [r[0] for r in state.select(cohort.gender_concept(F.col("s"))).collect()] == [8507, 8532]


def test_cohort_statistics(cdm):
    found = quality.cohort_statistics(
        cdm["person"], cdm["observation_period"], cdm["visit_occurrence"], cdm["condition_occurrence"]
    ).first()
    assert (found.persons, found.visits, found.unique_concepts) == (1, 3, 3)
    assert found.percent_er_visits == pytest.approx(100 / 3)
    assert found.mean_days_between_visits == pytest.approx((305 + 181 + 366) / 3)
    assert found.mean_concepts_per_visit == 1.0
