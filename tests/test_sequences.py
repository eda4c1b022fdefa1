from pyspark.sql import functions as F

from ehrseq.operators.quality import dense_visits, repeated_labels, unequal_arrays
from ehrseq.operators.sequences import collect_sequences, explode_sequences
from ehrseq.operators.numbering import busy_persons
from ehrseq.operators.tokens import create_tokens
from ehrseq.operators.visits import link_events_to_visits
from ehrseq.plans.process import prepare_events, process_tables, stage_mapping
from ehrseq.settings import MappingSettings
from ehrseq.sources import trial
from ehrseq.staging import Staging
from tests.conftest import SMALL, day, rows

NO_MAPPING = MappingSettings(map_drugs_to_ingredients=False)


def by_period(tokens, **options):
    return {r.observation_period_id: r for r in collect_sequences(tokens, **options).collect()}


def test_golden_sequences(cdm):
    found = by_period(process_tables(cdm, NO_MAPPING).tokens)
    assert sorted(found) == [11, 13]
    spring, later = found[11], found[13]
    assert spring.concept_ids == ["VS", "811", "VE", "M2", "VS", "822", "VE"]
    assert spring.visit_segments == [2, 2, 2, 0, 1, 1, 1]
    assert spring.dates == [2101, 2101, 2101, 0, 2111, 2111, 2111]
    assert spring.ages == [583, 583, 583, -1, 585, 585, 585]
    assert spring.visit_concept_orders == [1, 1, 1, 2, 2, 2, 2]
    assert spring.visit_concept_ids == ["9201"] * 3 + ["0"] + ["9203"] * 3
    assert spring.orders == list(range(7))
    assert (spring.num_of_concepts, spring.num_of_visits, spring.last_visit_start, spring.person_id) == (7, 2, 3, 5)
    assert later.concept_ids == ["VS", "VE"]
    assert (later.dates, later.ages, later.visit_segments) == ([2365, 2366], [644, 644], [2, 2])


def test_golden_sequence_with_a_new_visit(cdm):
    settings = MappingSettings(map_drugs_to_ingredients=False, concepts_to_remove=[])
    spring = by_period(process_tables(cdm, settings).tokens)[11]
    assert spring.concept_ids[7:] == ["M1", "VS", "0", "VE"]
    assert spring.visit_segments[7:] == [0, 2, 2, 2]
    assert spring.dates[7:] == [0, 2117, 2117, 2117]
    assert spring.ages[7:] == [-1, 587, 587, 587]
    assert spring.visit_concept_ids[7:] == ["0", "1", "1", "1"]


def test_run_counters(cdm):
    counters = process_tables(cdm, NO_MAPPING).counters.first()
    assert (counters.persons, counters.observation_periods) == (1, 3)
    assert (counters.removed_concepts, counters.removed_duplicates) == (1, 0)
    assert (counters.mapped_by_id, counters.mapped_by_date, counters.new_visits) == (1, 1, 1)


def test_counters_read_no_table(spark, cdm):
    """Everything was counted while it was written."""
    counters = process_tables({**cdm, "condition_occurrence": cdm["condition_occurrence"].unionAll(cdm["condition_occurrence"])}, NO_MAPPING).counters
    assert counters.first().asDict() == {
        "persons": 1,
        "observation_periods": 3,
        "removed_concepts": 2,
        "removed_duplicates": 2,
        "mapped_by_id": 1,
        "mapped_by_date": 1,
        "mapped_to_new_visit": 1,
        "used_new_visit": 1,
        "new_visits": 1,
        "existing_visits": 3,
    }
    text = counters._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" not in text and "Range" in text


def test_a_null_concept_follows_the_visit_end_and_is_not_counted(spark, cdm):
    table = cdm["condition_occurrence"].where("condition_concept_id = 811")
    nothing = table.withColumn("condition_concept_id", F.lit(None).cast("bigint"))
    tables = {**cdm, "condition_occurrence": table.unionAll(nothing)}
    first = by_period(process_tables(tables, NO_MAPPING).tokens)[11]
    assert first.concept_ids[:4] == ["VS", "811", "VE", None]
    assert first.orders == list(range(len(first.concept_ids)))
    assert first.num_of_concepts == len(first.concept_ids) - 1
    tokens = process_tables(tables, NO_MAPPING).tokens
    assert {r.sequence_length for r in tokens.where("observation_period_id = 11").collect()} == {first.num_of_concepts}
    checked = ("ages", "concept_ids", "dates", "orders", "visit_concept_orders", "visit_segments")
    for size in (100, 3):
        assert rows(unequal_arrays(collect_sequences(tokens, size)), "array", "sequences", "unequal") == [(n, 2, 1) for n in checked]


def test_unknown_persons_keep_only_intervals(cdm):
    tables = {**cdm, "person": cdm["person"].where("person_id = 99")}
    first = by_period(process_tables(tables, NO_MAPPING).tokens)
    assert {k: v.concept_ids for k, v in first.items()} == {11: ["M2"]}


def test_a_visit_in_two_periods_is_in_both_sequences(spark, cdm):
    overlapping = spark.createDataFrame(
        [(5, 19, day("2010-01-01"), day("2010-04-20"))], cdm["observation_period"].schema
    )
    tables = {**cdm, "observation_period": cdm["observation_period"].unionAll(overlapping)}
    found = by_period(process_tables(tables, NO_MAPPING).tokens)
    assert found[19].concept_ids == ["VS", "811", "VE"]
    assert len(found[11].concept_ids) == 7


def test_labels_keep_labelled_persons_and_repeat_tokens(spark, cdm):
    settings = MappingSettings(map_drugs_to_ingredients=False, has_labels=True)
    schema = "person_id bigint, label boolean"
    other = spark.createDataFrame([(2, True)], schema)
    assert process_tables(cdm, settings, other).tokens.count() == 0
    once = by_period(process_tables(cdm, settings, spark.createDataFrame([(5, True)], schema)).tokens)
    assert once[11].label is True and len(once[11].concept_ids) == 7
    labels = spark.createDataFrame([(5, True), (5, False)], schema)
    twice = by_period(process_tables(cdm, settings, labels).tokens)
    assert twice[11].concept_ids[:4] == ["VS", "VS", "811", "811"]
    assert twice[11].orders == list(range(14)) and twice[11].label is True
    assert rows(repeated_labels(labels)) == [(5, 2)]


def test_hot_persons_and_visits_give_the_same_tokens(spark):
    """Cutting persons into months and visits into concepts changes nothing."""
    tables = trial.cdm_tables(spark, SMALL)
    stage = Staging(spark)
    events = stage(prepare_events(tables, MappingSettings(), stage_mapping(tables, stage))["distinct"], "events")
    visits = tables["visit_occurrence"]
    labels = trial.labels(spark, SMALL)
    results = []
    for busy_rows, large in ((10**9, 10**9), (45, 1), (0, 2)):
        stage = Staging(spark)
        busy = busy_persons([events, visits, tables["observation_period"]], stage, busy_rows)
        assert (busy is None) == (busy_rows == 10**9)
        linked = link_events_to_visits(events, visits, 1, busy, stage)
        tokens = create_tokens(tables, linked.events, linked.visits, labels, busy, stage, large)
        results.append((rows(linked.statistics), rows(tokens)))
    assert results[0] == results[1] == results[2]
    assert len(results[0][1]) > 5000


def test_sequence_invariants(spark):
    tokens = process_tables(trial.cdm_tables(spark, SMALL), MappingSettings()).tokens
    tokens = Staging(spark)(tokens, "tokens")
    found = collect_sequences(tokens).collect()
    for row in found:
        n = row.num_of_concepts
        assert row.orders == list(range(n))
        assert all(len(a) == n for a in (row.concept_ids, row.dates, row.ages, row.visit_segments, row.visit_concept_orders, row.visit_concept_ids))
        assert row.visit_concept_orders == sorted(row.visit_concept_orders)
        assert row.concept_ids.count("VS") == row.concept_ids.count("VE") == row.num_of_visits
        first_of_last = row.visit_concept_orders.index(row.num_of_visits)
    facts = tokens.select("observation_period_id", "sequence_length", "num_of_visits", "last_visit_start").distinct()
    expected = {
        r.observation_period_id: (r.num_of_concepts, r.num_of_visits, r.visit_concept_orders.index(r.num_of_visits))
        for r in found
    }
    assert {r[0]: tuple(r[1:]) for r in facts.collect()} == expected
    assert first_of_last >= 0


def test_long_sequences_continue_on_further_rows(cdm):
    tokens = process_tables(cdm, NO_MAPPING).tokens
    parts = sorted(
        (r.part, r.orders, r.concept_ids) for r in collect_sequences(tokens, tokens_per_row=3).collect() if r.observation_period_id == 11
    )
    assert [p[1] for p in parts] == [[0, 1, 2], [3, 4, 5], [6]]
    assert sum([p[2] for p in parts], []) == ["VS", "811", "VE", "M2", "VS", "822", "VE"]
    whole, cut = (dense_visits(collect_sequences(tokens, n)).first() for n in (100, 3))
    assert whole == cut


def test_exploding_sequences_gives_the_tokens_back(spark, cdm):
    columns = ["observation_period_id", "orders", "concept_ids", "dates", "sequence_length", "num_of_visits", "last_visit_start"]
    many = process_tables(trial.cdm_tables(spark, SMALL), MappingSettings()).tokens
    for tokens in (process_tables(cdm, NO_MAPPING).tokens, Staging(spark)(many, "tokens")):
        for size in (10**6, 3):
            assert rows(explode_sequences(collect_sequences(tokens, size)), *columns) == rows(tokens, *columns)


def test_large_visits_keep_their_order_with_nulls(spark):
    """Null concepts, null dates and long visits: the same positions whatever counts as large or busy."""
    make = spark.createDataFrame
    visit_schema = "person_id bigint, visit_occurrence_id bigint, visit_start_date date, visit_end_date date, visit_concept_id bigint"
    visits = [(p, 10 * p + k, day(f"200{k}-03-01"), day(f"200{k + 1}-02-20"), 9201) for p in (1, 2) for k in (1, 2, 3)]
    event_schema = "person_id bigint, start_date date, concept_id bigint, visit_occurrence_id bigint"
    dates = [None, day("2001-03-05"), day("2001-03-28"), day("2001-09-09"), day("2002-01-31")]
    events = [(p, d, c, 10 * p + 1) for p in (1, 2) for d in dates for c in (None, 7, 123, 456)]
    events += [(1, day("2003-05-05"), 9, None), (2, None, 9, None)]
    tables = {
        "person": make([(1, 1960, 1, 1, 0), (2, None, None, None, 0)], "person_id bigint, year_of_birth int, month_of_birth int, day_of_birth int, gender_concept_id bigint"),
        "observation_period": make([(p, p, day("2000-01-01"), day("2009-01-01")) for p in (1, 2)], "person_id bigint, observation_period_id bigint, observation_period_start_date date, observation_period_end_date date"),
    }
    results = []
    for busy_rows in (10**9, 0):
        for large in (10**9, 1):
            stage = Staging(spark)
            given, known = stage(make(events, event_schema), "events"), make(visits, visit_schema)
            busy = busy_persons([given, known], stage, busy_rows)
            linked = link_events_to_visits(given, known, 1, busy, stage)
            tokens = stage(create_tokens(tables, linked.events, linked.visits, None, busy, stage, large), "tokens")
            results.append(rows(tokens))
            for period in (1, 2):
                orders = [r.orders for r in tokens.where(f"observation_period_id = {period}").collect()]
                assert sorted(orders) == list(range(len(orders)))
    assert all(r == results[0] for r in results)
