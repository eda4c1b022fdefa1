import pytest
from pyspark.sql import functions as F

from ehrseq.functions.dates import age_in_months, interval_token, week_index
from ehrseq.operators import events as ev
from ehrseq.operators.sizes import join_lookup
from tests.conftest import day, rows

EVENT = "person_id bigint, start_date date, concept_id bigint, visit_occurrence_id bigint"


def test_union_has_all_events_and_the_death_concept(cdm):
    union = ev.union_domain_tables(cdm)
    assert union.count() == 4
    assert rows(union.where("start_date = DATE'2019-11-30'"), "concept_id", "visit_occurrence_id") == [(4306655, None)]


def test_union_takes_the_tables_that_exist(cdm):
    assert ev.union_domain_tables({"death": cdm["death"]}).count() == 1


def test_removed_concepts_go_and_null_concepts_stay(spark, cdm):
    union = ev.union_domain_tables(cdm)
    kept = ev.remove_concepts(union, [0])
    assert kept.count() == 3 and union.count() == 4
    assert tuple(ev.count_removed(union, [0]).first()) == (1, 3)
    nothing = spark.createDataFrame([(1, day("2000-01-01"), None, None)], EVENT)
    assert ev.remove_concepts(nothing, [0]).count() == 1
    assert ev.remove_concepts(union, []).count() == 4


def test_duplicates_compare_all_columns(spark):
    leap = day("2004-02-29")
    given = [(8, leap, 31, None), (8, leap, 31, None), (9, leap, 31, None), (8, leap, None, None), (8, None, 31, None), (8, None, 31, None)]
    frame = spark.createDataFrame(given, EVENT)
    assert ev.remove_duplicates(frame).count() == 4
    assert ev.remove_duplicates(frame.unionAll(frame.withColumn("visit_occurrence_id", F.lit(5)))).count() == 8


def test_date_of_birth_defaults_and_overflow(spark):
    born = [
        (1, 1955, 11, 30),
        (2, 1972, 8, None),
        (3, 1986, None, None),
        (4, 2001, 2, 31),
        (5, None, 12, 24),
    ]
    person = spark.createDataFrame(
        born, "person_id bigint, year_of_birth int, month_of_birth int, day_of_birth int"
    )
    assert rows(ev.add_date_of_birth(person), "person_id", "date_of_birth") == [
        (1, day("1955-11-30")),
        (2, day("1972-08-01")),
        (3, day("1986-01-01")),
        (4, day("2001-03-03")),
        (5, None),
    ]


def test_interval_tokens_at_their_limits(spark):
    days = [-1, 0, 6, 7, 27, 28, 29, 30, 359, 360]
    frame = spark.createDataFrame([(d,) for d in days], "d int").select("d", interval_token(F.col("d")).alias("t"))
    found = {r.d: r.t for r in frame.collect()}
    assert found == {
        -1: "W-1",
        0: "W0",
        6: "W0",
        7: "W1",
        27: "W3",
        28: "M0",
        29: "M0",
        30: "M1",
        359: "M11",
        360: "LT",
    }


def test_weeks_and_months(spark):
    frame = spark.createDataFrame(
        [(day("1970-01-31"), day("1970-01-07")), (day("1970-01-31"), day("1970-02-01"))], "birth date, d date"
    )
    got = frame.select(week_index(F.col("d")), age_in_months(F.col("birth"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(0, 0), (4, 1)]


@pytest.mark.parametrize("max_rows", [0, 1_000_000])
def test_mapping_drops_and_multiplies_whatever_the_join(spark, max_rows):
    drugs = spark.createDataFrame([(1, 10, "a"), (2, 11, "b"), (3, 12, "c")], "person_id bigint, drug bigint, x string")
    concept = spark.createDataFrame(
        [(100, "Ingredient"), (101, "Ingredient"), (102, "Clinical Drug")], "concept_id bigint, concept_class_id string"
    )
    ancestor = spark.createDataFrame(
        [(100, 10), (101, 10), (102, 10), (100, 11), (102, 12)],
        "ancestor_concept_id bigint, descendant_concept_id bigint",
    )
    mapping = ev.ingredient_mapping(concept, ancestor)
    assert rows(mapping) == [(10, 100), (10, 101), (11, 100)]
    mapped = ev.map_concepts(drugs, "drug", mapping)
    assert mapped.columns == ["person_id", "x", "drug"]
    assert rows(mapped) == [(1, "a", 100), (1, "a", 101), (2, "b", 100)]
    joined = join_lookup(drugs, mapping, drugs["drug"] == mapping["source_concept_id"], "inner", max_rows)
    assert joined.count() == 3
