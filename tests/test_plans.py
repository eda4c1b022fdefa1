"""What the plans must and must not contain."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ehrseq.operators import sizes
from ehrseq.operators.events import ingredients, map_concepts
from ehrseq.operators.numbering import busy_persons
from ehrseq.operators.ranges import within_period
from ehrseq.operators.sequences import collect_sequences
from ehrseq.operators.sizes import join_lookup
from ehrseq.operators.tokens import rank_visits, token_stream
from ehrseq.operators.visits import key_visits, link_by_date, link_by_id, resolve_days, resolve_events, unlinked_days
from ehrseq.operators.vocabulary import encode
from ehrseq.plans.trial_run import trial_run
from ehrseq.settings import ExampleSettings
from ehrseq.operators.examples import build_examples, truncate
from ehrseq.sources import buckets
from ehrseq.sources import cdm as source
from ehrseq.staging import Staging, measured
from tests.conftest import SMALL

QUERIES = __spark_entry__.queries()
# The classifier is Spark's own; its transform is not a SQL expression. Text operators may use Python.
PLANNED = sorted(n for n in QUERIES if not n.startswith("op") and n not in ("baseline_fit", "pipeline"))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for node in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert node not in text


def test_class_filter_and_columns_reach_the_scan(spark, tmp_path):
    concept = spark.createDataFrame(
        [(1, "Ingredient", "x"), (2, "Other", "y")], "concept_id bigint, concept_class_id string, concept_name string"
    )
    concept.write.parquet(str(tmp_path / "concept"))
    text = plan(ingredients(source.read_table(spark, str(tmp_path), "concept")))
    assert "EqualTo(concept_class_id,Ingredient)" in text
    assert "ReadSchema: struct<concept_id:bigint,concept_class_id:string>" in text


def test_tail_truncation_reaches_the_scan_as_one_filter(spark):
    run = trial_run(spark, SMALL)
    text = plan(truncate(run.tokens, ExampleSettings(max_length=16, truncate="tail")).select("concept_ids"))
    assert "Exchange" not in text
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in columns.split(",")} == {"concept_ids", "orders", "sequence_length"}


def test_examples_shuffle_once(spark):
    run = trial_run(spark, SMALL)
    settings = ExampleSettings(
        max_length=16, truncate="tail", mask_concepts=True, one_mask_per_visit=True, mask_visits=True
    )
    text = plan(build_examples(run.tokens, run.vocabulary, run.visit_vocabulary, settings))
    assert text.count("Exchange hashpartitioning") == 1


def _jobs(spark, work):
    """Spark jobs that ``work`` runs."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_join_to_a_measured_lookup_runs_no_job(spark):
    run = trial_run(spark, SMALL)
    mapping, drugs, tokens, vocabulary = run.mapping, run.tables["drug_exposure"], run.tokens, run.vocabulary
    assert measured(mapping).rows == mapping.count() and measured(mapping).bytes > 0
    assert _jobs(spark, lambda: map_concepts(drugs, "drug_concept_id", mapping)) == 0
    assert _jobs(spark, lambda: encode(tokens, "concept_ids", vocabulary, "token_id")) == 0
    # The mapping is read as written, not joined again.
    text = plan(map_concepts(drugs, "drug_concept_id", mapping))
    assert text.count("Join") == plan(drugs).count("Join") + 1 and "ReadSchema: struct<source_concept_id" in text


def test_a_large_lookup_is_not_broadcast(spark, monkeypatch):
    lookup = Staging(spark).measured(spark.range(50).withColumn("token_id", F.col("id")), "lookup")
    large = spark.range(100)
    assert "BroadcastHashJoin" in plan(join_lookup(large, lookup, "id", "left"))
    assert "SortMergeJoin" in plan(join_lookup(large, lookup, "id", "left", max_rows=49))
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 10)
    assert "SortMergeJoin" in plan(join_lookup(large, lookup, "id", "left"))


def test_staged_tables_know_what_was_counted(spark):
    stage = Staging(spark)
    for n, total in ((0, None), (5, 10)):
        seen = measured(stage.measured(spark.range(n), f"table_{n}", {"total": F.sum("id")}))
        assert (seen.rows, seen.values) == (n, {"total": total}) and (seen.bytes > 0 or not n)
    assert measured(spark.range(3)) is None and measured(stage(spark.range(3), "plain")) is None


@pytest.fixture(scope="module")
def cut_by_person(spark):
    """Tables bucketed by person, and joins that must not be broadcast."""
    run, folder, prefix = trial_run(spark, SMALL), Staging(spark).folder, f"plans_{uuid.uuid4().hex}"
    linked, tables = run.linked, run.tables
    cdm = ["visit_occurrence", "observation_period", "person"]
    buckets.write_cdm_bucketed({n: tables[n] for n in cdm}, folder, prefix, 8)
    buckets.write_bucketed({"linked_by_id": run.linked_by_id, "all_visits": linked.visits}, folder, prefix, 8)
    buckets.write_bucketed({"linked_events": linked.events}, folder, prefix, 8, by="visit_person_id")
    names = [*cdm, "linked_by_id", "all_visits", "linked_events"]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield {flag: buckets.read_bucketed(spark, folder, prefix, names, flag) for flag in (True, False)}
    for k, v in before.items():
        spark.conf.set(k, v)
    buckets.drop_bucketed(spark, prefix, names)


def _by_person(tables):
    visits, periods = tables["visit_occurrence"], tables["observation_period"]
    return {
        "linked": link_by_date(tables["linked_by_id"], key_visits(visits), cut_by_person=True),
        "period": within_period(visits, "visit_start_date", periods),
        "ranked": rank_visits(tables["all_visits"], periods, tables["person"], tables["linked_events"]),
    }


def test_bucketed_tables_are_not_shuffled_by_person(cut_by_person):
    bucketed, plain = (_by_person(cut_by_person[flag]) for flag in (True, False))
    for name in bucketed:
        assert "Exchange" not in plan(bucketed[name]) and "Bucketed: true" in plan(bucketed[name])
        assert "Exchange" in plan(plain[name])
        assert sorted(map(str, bucketed[name].collect())) == sorted(map(str, plain[name].collect()))


def test_tokens_are_ranked_where_they_met_their_visit(spark, cut_by_person):
    """No shuffle but the two of the join by visit, and none for what begins and ends a visit."""
    run = trial_run(spark, SMALL)
    text = plan(token_stream(run.linked.events, run.ranked_visits))
    assert text.count("Exchange") == 2 and "visit_concept_orders" not in "".join(x for x in text.splitlines() if "Exchange" in x)
    assert plan(collect_sequences(run.tokens)).count("Exchange") == 1


def test_visits_meet_their_events_by_person(spark, cut_by_person):
    """Visits and events move once, by person, and the counts are those of a join."""
    run, joined = trial_run(spark, SMALL), {}
    for flag in (False, True):
        joined[flag] = rank_visits(run.linked.visits, run.tables["observation_period"], run.tables["person"], run.linked.events, meet_by_person=flag)
    assert plan(joined[True]).count("Exchange") < plan(joined[False]).count("Exchange")
    assert sorted(map(str, joined[True].collect())) == sorted(map(str, joined[False].select(*joined[True].columns).collect()))


def test_sequence_files_are_written_from_the_tokens(spark):
    """Sequences go to their files at once, and not to a staged table first."""
    folder = SMALL.replace("testdata", "../root/testdata")
    rows = QUERIES["sequence_files"](spark, folder).count()
    run = trial_run(spark, folder)
    assert "sequences" not in run.__dict__ and rows == collect_sequences(run.tokens).count() > 0


def test_a_task_gets_no_more_rows_when_the_tables_grow(spark, monkeypatch):
    """Cut by their rows, not by bytes: so many tasks as the rows need, and the same result."""
    run = trial_run(spark, SMALL)
    events, tables, linked = run.linked.events, run.tables, run.linked_by_id
    ranked = run.ranked_visits
    made = {
        "resolved": lambda: resolve_events(linked, resolve_days(unlinked_days(linked), run.keyed_visits)),
        "ranked": lambda: rank_visits(run.linked.visits, tables["observation_period"], tables["person"], events, run.labels, meet_by_person=True),
        "tokens": lambda: token_stream(events, ranked),
    }
    plain = {name: make() for name, make in made.items()}
    monkeypatch.setattr(sizes, "ROWS_PER_TASK", 100)
    for name, make in made.items():
        fine = make()
        assert "REPARTITION_BY_NUM" in plan(fine) and "REPARTITION_BY_NUM" not in plan(plain[name])
        assert sorted(map(str, fine.collect())) == sorted(map(str, plain[name].collect()))


def test_linking_by_date_is_cut_by_rows(spark, monkeypatch):
    run = trial_run(spark, SMALL)
    plain = link_by_date(run.linked_by_id, run.keyed_visits)
    monkeypatch.setattr(sizes, "ROWS_PER_TASK", 100)
    fine = link_by_date(run.linked_by_id, run.keyed_visits)
    # The events, the visits, and days with ranges.
    assert plan(fine).count("REPARTITION_BY_NUM") >= 3 and "REPARTITION_BY_NUM" not in plan(plain)
    assert sorted(map(str, fine.collect())) == sorted(map(str, plain.collect()))


def test_events_without_visit_id_are_not_moved(spark):
    run = trial_run(spark, SMALL)
    text = plan(link_by_id(run.distinct_events, run.keyed_visits))
    assert "Union" in text and "_spread" not in text


def test_buckets_grow_with_the_tables():
    assert [buckets.buckets_for(n, 8) for n in (0, 10**6, 4_000_001, 36_000_000)] == [8, 8, 9, 72]


def test_linking_in_place_is_linking(spark):
    run = trial_run(spark, SMALL)
    one, other = (link_by_date(run.linked_by_id, run.keyed_visits, run.busy, cut) for cut in (False, True))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.select(*one.columns).collect()))


def test_events_without_visit_id_spread_over_partitions(spark):
    """The join by visit id must not send all events without one to the same task."""
    events = spark.range(20000).select(
        F.col("id").alias("person_id"),
        F.lit("2000-01-01").cast("date").alias("start_date"),
        F.lit(5).cast("bigint").alias("concept_id"),
        F.lit(None).cast("bigint").alias("visit_occurrence_id"),
    )
    visits = spark.range(10).select(
        F.col("id").alias("person_id"),
        F.col("id").alias("visit_occurrence_id"),
        F.lit("2000-01-01").cast("date").alias("visit_start_date"),
        F.lit("2000-01-01").cast("date").alias("visit_end_date"),
        F.lit(9201).alias("visit_concept_id"),
    )
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        linked = link_by_id(events, key_visits(visits))
        sizes = [r["n"] for r in linked.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20000 and max(sizes) < 0.5 * sum(sizes)


def test_a_hot_visit_id_is_split(spark):
    """A third of all events name the same visit: adaptive execution splits that partition."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000)
    events = spark.range(300000).select(
        F.col("id").alias("person_id"),
        F.lit("2000-01-01").cast("date").alias("start_date"),
        F.xxhash64("id").alias("concept_id"),
        hot.cast("bigint").alias("visit_occurrence_id"),
    )
    visits = spark.range(5000).select(
        F.col("id").alias("person_id"),
        F.col("id").alias("visit_occurrence_id"),
        F.lit("2000-01-01").cast("date").alias("visit_start_date"),
        F.lit("2000-01-01").cast("date").alias("visit_end_date"),
        F.lit(9201).alias("visit_concept_id"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "20",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "500KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        linked = link_by_id(events, key_visits(visits))
        assert len(linked.where("id_from_id IS NOT NULL").collect()) == 300000
        linked.collect()
        text = plan(linked)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "skew=true" in text


def test_a_busy_person_is_found_among_all_tables(spark):
    rows = spark.createDataFrame([(1,)] * 6 + [(2,)] * 3 + [(None,)] * 9, "person_id bigint")
    more = spark.createDataFrame([(2,)] * 3, "person_id bigint")
    busy = busy_persons([rows, more], Staging(spark), 5)
    assert sorted(r[0] for r in busy.collect()) == [1, 2]
