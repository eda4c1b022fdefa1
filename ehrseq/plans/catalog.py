"""Named queries over trial tables, one for each operator."""

import uuid
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ehrseq.operators import baseline, cohort, examples, metrics, quality, study, visits, vocabulary
from ehrseq.operators.events import (
    add_date_of_birth,
    count_removed,
    ingredients,
    map_concepts,
)
from ehrseq.operators.numbering import number_rows
from ehrseq.operators.sequences import collect_sequences, explode_sequences
from ehrseq.operators.tokens import event_tokens, interval_tokens, visit_tokens
from ehrseq.operators.vocabulary import split_by_person
from ehrseq.plans.oracle import ADAM_STEPS, LENGTH
from ehrseq.plans.process import process_cdm_data
from ehrseq.plans.trial_run import SEED, TRAIN_FRACTION, trial_run
from ehrseq.schema import PERIOD_KEY, SEQUENCE_TABLE
from ehrseq.settings import ExampleSettings
from ehrseq.sources import buckets, files, trial
from ehrseq.sources.cdm import read_all_labels, read_cdm, write_cdm, write_labels
from ehrseq.staging import Staging, like_measured

QUERIES = {}
TOKEN_LIST = [
    *PERIOD_KEY,
    "concept_ids",
    "visit_segments",
    "dates",
    "ages",
    "visit_concept_orders",
    "visit_concept_ids",
    "sort_order",
]


def plain(frame: DataFrame) -> DataFrame:
    """Types any engine can show alike: whole numbers, rounded fractions, and text for the rest."""
    columns = []
    for name, kind in frame.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith("array"):
            whole = {"array<boolean>": "array<int>", "array<float>": "array<bigint>"}.get(kind, kind)
            column = F.concat_ws(",", column.cast(whole).cast("array<string>"))
        elif kind in ("boolean", "int", "bigint", "decimal(38,0)"):
            column = column.cast("bigint")
        elif kind in ("double", "float"):
            column = F.round(column.cast("double"), 6)
        else:
            column = column.cast("string")
        columns.append(column.alias(name))
    return frame.select(*columns)


def query(function):
    """Register a query under its function's name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(function(trial_run(spark, folder)))

    QUERIES[function.__name__] = run
    return run


# Sources and event preparation


@query
def cdm_scan(run):
    counts = [
        frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, frame in run.tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def label_scan(run):
    return run.labels


@query
def date_of_birth(run):
    return add_date_of_birth(run.tables["person"]).select("person_id", "date_of_birth")


@query
def gender_concept(run):
    state = F.col("person_id") % 2
    concept = cohort.gender_concept(state).alias("gender_concept_id")
    return run.tables["person"].groupBy(concept).agg(F.count("*").alias("n"))


@query
def concept_ingredients(run):
    return ingredients(run.tables["concept"])


@query
def ingredient_mapping(run):
    return run.mapping


@query
def drug_to_ingredient(run):
    return map_concepts(run.tables["drug_exposure"], "drug_concept_id", run.mapping)


@query
def union_domains(run):
    return run.events["union"]


@query
def remove_concepts(run):
    return run.events["kept"]


@query
def removed_concepts(run):
    return count_removed(run.events["union"], run.settings.concepts_to_remove).select("removed_concepts")


@query
def remove_duplicates(run):
    return run.events["distinct"]


# Visits


@query
def link_by_id(run):
    return run.linked_by_id


@query
def link_by_date(run):
    return visits.link_by_date(run.linked_by_id, run.keyed_visits, run.busy)


@query
def new_visits(run):
    days = visits.resolve_days(visits.unlinked_days(run.linked_by_id), run.keyed_visits, run.busy)
    return visits.new_visits(days, run.settings.missing_visit_concept_id)


@query
def link_events(run):
    return run.linked.events.select("person_id", "concept_id", "start_date", "visit_person_id", "visit_seq")


@query
def all_visits(run):
    return run.linked.visits


@query
def visit_numbers(run):
    blocks = run.tables["visit_occurrence"].withColumn("_block", F.year("visit_start_date"))
    order = ["visit_start_date", "visit_end_date", "visit_occurrence_id"]
    numbered = number_rows(blocks, "visit_number", ["person_id"], "_block", order)
    return numbered.select("person_id", "visit_occurrence_id", "visit_number")


@query
def link_statistics(run):
    return run.linked.statistics


# Tokens and sequences


@query
def visits_in_period(run):
    return run.ranked_visits.select(*PERIOD_KEY, "visit_seq", "visit_rank", "previous_end")


@query
def interval_token_rows(run):
    return interval_tokens(run.ranked_visits).select(*TOKEN_LIST)


@query
def visit_token_rows(run):
    return visit_tokens(run.ranked_visits).select(*TOKEN_LIST)


@query
def event_token_rows(run):
    return event_tokens(run.linked.events, run.ranked_visits).select(*TOKEN_LIST)


@query
def token_stream(run):
    return run.tokens


@query
def sequences(run):
    return collect_sequences(run.tokens)


@query
def labelled_sequences(run):
    return collect_sequences(run.labelled_tokens)


@query
def pipeline_counters(run):
    return run.counters


# Vocabulary


@query
def train_test_split(run):
    side = F.when(vocabulary.in_training_split(TRAIN_FRACTION, SEED), "train").otherwise("test")
    return run.tokens.groupBy("person_id", side.alias("side")).agg(F.count("*").alias("n"))


@query
def concept_vocabulary(run):
    return vocabulary.fit_vocabulary(run.training_tokens, "concept_ids")


@query
def visit_vocabulary(run):
    return vocabulary.fit_vocabulary(run.training_tokens, "visit_concept_ids")


@query
def vocabulary_facts(run):
    return vocabulary.vocabulary_facts(run.vocabulary)


def _listed(frame, column, name):
    """One array per period in sequence order."""
    items = F.sort_array(F.collect_list(F.struct("orders", column)))
    return frame.groupBy(*PERIOD_KEY).agg(items[column].alias(name))


@query
def encode(run):
    encoded = vocabulary.encode(run.tokens, "concept_ids", run.vocabulary, "token_id")
    return _listed(encoded, "token_id", "token_ids")


@query
def decode(run):
    encoded = vocabulary.encode(run.tokens, "concept_ids", run.vocabulary, "token_id")
    ids = encoded.select(*PERIOD_KEY, "orders", "token_id")
    return _listed(vocabulary.decode(ids, "token_id", run.vocabulary, "word"), "word", "concept_ids")


@query
def vocabulary_listing(run):
    return vocabulary.list_vocabulary(run.tokens, "concept_ids")


# Examples


def _settings(**options):
    return ExampleSettings(**{"max_length": LENGTH, "truncate": "tail", "seed": SEED, **options})


def _truncated(run, settings):
    kept = vocabulary.encode(
        examples.truncate(run.tokens, settings), "concept_ids", run.vocabulary, "token_id"
    )
    items = F.sort_array(F.collect_list(F.struct("orders", "token_id")))
    return kept.groupBy(*PERIOD_KEY).agg(
        F.min("orders").alias("first"), F.max("orders").alias("last"), items["token_id"].alias("token_ids")
    )


def _examples(run, **options):
    return examples.build_examples(run.tokens, run.vocabulary, run.visit_vocabulary, _settings(**options))


@query
def truncate_tail(run):
    return _truncated(run, _settings())


@query
def truncate_random(run):
    return _truncated(run, _settings(truncate="random"))


@query
def truncate_next_visit(run):
    return _truncated(run, _settings(next_visit=True))


@query
def model_inputs(run):
    return _inputs(_examples(run))


def _inputs(built):
    real = F.size(F.filter("padding_mask", lambda x: x == 0))
    return built.withColumn("unpadded", real).drop("padding_mask")


@query
def examples_from_sequences(run):
    """Inputs built from stored sequence rows, as training starts."""
    path = _folder(run, "sequences")
    files.write_sequences(collect_sequences(run.tokens), path)
    tokens = explode_sequences(files.read_sequences(run.spark, path))
    return _inputs(examples.build_examples(tokens, run.vocabulary, run.visit_vocabulary, _settings()))


@query
def evaluation_inputs(run):
    """What a model trained with masks is evaluated on."""
    trained = _settings(mask_concepts=True, one_mask_per_visit=True, mask_visits=True)
    return _inputs(examples.build_examples(run.tokens, run.vocabulary, run.visit_vocabulary, trained.for_evaluation()))


def _mask_columns(built, shown, mask):
    return built.select(*PERIOD_KEY, F.col(shown).alias("shown"), F.col(mask).alias("unmasked"))


@query
def mask_concepts(run):
    return _mask_columns(_examples(run, mask_concepts=True), "masked_token_ids", "masked_token_mask")


@query
def mask_one_per_visit(run):
    built = _examples(run, mask_concepts=True, one_mask_per_visit=True)
    return _mask_columns(built, "masked_token_ids", "masked_token_mask")


@query
def mask_visits(run):
    built = _examples(run, mask_visits=True)
    return _mask_columns(built, "masked_visit_token_ids", "masked_visit_token_mask")


@query
def next_token(run):
    return _examples(run, next_token=True).select(*PERIOD_KEY, "token_ids", "next_token_ids")


@query
def next_visit_set(run):
    return _examples(run, next_visit=True).select(*PERIOD_KEY, "next_visit_token_set")


@query
def next_visit_dense(run):
    built = _examples(run, next_visit=True, dense_next_visit=True)
    return built.select(*PERIOD_KEY, "next_visit_token_set")


@query
def label_output(run):
    built = examples.build_examples(
        run.labelled_tokens, run.vocabulary, run.visit_vocabulary, _settings(label=True)
    )
    return built.select(*PERIOD_KEY, "finetune_label")


def _labelled_examples(run):
    return examples.build_examples(run.labelled_tokens, run.vocabulary, run.visit_vocabulary, _settings(label=True))


@query
def training_cap(run):
    """The labelled training examples of a small step of a learning curve."""
    training = split_by_person(_labelled_examples(run), TRAIN_FRACTION, SEED)[0]
    return examples.cap_training_set(training, 200, SEED).select(*PERIOD_KEY)


# Baseline


def _weights(run):
    weight = (F.col("token_id") % 17 - 8) / 10.0
    return like_measured(run.vocabulary.select("token_id", weight.alias("weight")), run.vocabulary)


@query
def token_presence(run):
    return baseline.token_presence(_examples(run)).select(*PERIOD_KEY, "present")


@query
def baseline_scores(run):
    return baseline.baseline_scores(_examples(run), _weights(run), 0.25)


@query
def baseline_fit(run):
    """Fitted on all examples of the training persons; on all examples, whether the weights score like the model."""
    # Training and both scorings read them; the classifier needs no other input.
    built = _labelled_examples(run).select(*PERIOD_KEY, "token_ids", "finetune_label")
    built, size = run.stage(built, f"labelled_examples_{uuid.uuid4().hex}"), run.vocabulary.count()
    model = baseline.fit_baseline(split_by_person(built, TRAIN_FRACTION, SEED)[0], size, stage=run.stage)
    ours = baseline.baseline_scores(built, baseline.model_weights(model, run.spark), model.intercept)
    theirs = model.transform(baseline.presence_vectors(built, size, run.stage)).select(
        *PERIOD_KEY, vector_to_array("probability")[1].alias("probability")
    )
    same = F.abs(F.col("prediction") - F.col("probability")) < 1e-9
    return ours.join(theirs, PERIOD_KEY).select(*PERIOD_KEY, same.cast("bigint").alias("same"))


@query
def baseline_gradient_fit(run):
    """A few steps of the definition's own optimiser on all training examples."""
    training = split_by_person(_labelled_examples(run), TRAIN_FRACTION, SEED)[0]
    settings = baseline.AdamSettings(steps=ADAM_STEPS, learning_rate=0.05, weight_decay=0.01)
    return baseline.fit_by_gradient(training, run.vocabulary, settings, stage=run.stage)


@query
def presence_vectors(run):
    """The places of each sparse vector, as the classifier gets them."""
    built = baseline.presence_vectors(_labelled_examples(run), run.vocabulary.count(), run.stage)
    parts = F.from_json(F.to_json(F.struct("features")), "features struct<size bigint, indices array<bigint>>").getField("features")
    return built.select(*PERIOD_KEY, parts["size"].alias("size"), parts["indices"].alias("places"), "finetune_label")


# Metrics

CELL = ["pretrained_model", "fine_tuned_model"]


@query
def roc_auc(run):
    return metrics.roc_auc(run.predictions, CELL)


@query
def average_precision(run):
    return metrics.average_precision(run.predictions, CELL)


@query
def brier_score(run):
    return run.predictions.groupBy(*CELL).agg(metrics.brier_score().alias("brier"))


@query
def binary_cross_entropy(run):
    return run.predictions.groupBy(*CELL).agg(metrics.mean_binary_cross_entropy().alias("mean_loss"))


@query
def metric_rows(run):
    return metrics.metric_rows(metrics.label_metrics(run.predictions, CELL, stage=run.stage), CELL, "label prediction", False)


@query
def metric_table(run):
    rows = metrics.metric_rows(metrics.label_metrics(run.predictions, CELL, stage=run.stage), CELL, "label prediction", False)
    names = [f"validation label prediction {name}" for name in ("mean loss", "AUC", "AUPRC", "Brier score")]
    return metrics.metric_table(rows, CELL, names)


@query
def metric_state(run):
    """Counts of two runs, the second added when the first were written, as metrics of each epoch's
    training and validation rows."""
    keys = ["pretrained_model", "epoch", "is_train"]
    predictions = trial.epoch_predictions(run.spark, run.folder)
    path = _folder(run, "score_counts")
    for half in (0, 1):
        files.append_score_counts(metrics.score_counts(predictions.where(F.col("run") == half), keys), path)
    counts = run.stage(metrics.merge_counts(files.read_score_counts(run.spark, path), keys), f"merged-{uuid.uuid4().hex}")
    return metrics.metric_rows(metrics.metrics_of_counts(counts, keys), keys, "label prediction", "is_train")


def _unmasked():
    return F.element_at("logits", 1) > 0


@query
def token_accuracy(run):
    return metrics.token_metrics(run.logits, [], ignored=_unmasked()).select("mean_accuracy")


@query
def token_cross_entropy(run):
    return metrics.token_metrics(run.logits, [], ignored=_unmasked()).select("mean_loss")


@query
def next_token_metrics(run):
    return metrics.token_metrics(run.logits, [])


def _multi(run):
    belongs = F.transform("logits", lambda _, i: F.when(i % 10 == F.col("target"), 1.0).otherwise(0.0))
    return run.logits.withColumn("targets", belongs)


@query
def multi_label_metrics(run):
    return metrics.multi_label_metrics(_multi(run), [])


@query
def combined_loss(run):
    per_objective = [
        metrics.token_metrics(run.logits, [], ignored=_unmasked()),
        metrics.token_metrics(run.logits, []),
        metrics.multi_label_metrics(_multi(run), []),
    ]
    return metrics.combined_loss(per_objective, [])


# Studies

FOLDERS = [("train A", "A"), ("train N", "N"), ("train R", "R")]


def _grid(run):
    orders = trial.read(run.spark, run.folder, "orders")
    priority = F.col("o_orderpriority").alias("pretrained_model")
    pretrained = orders.groupBy(priority).agg(F.count_distinct(F.year("o_orderdate")).alias("num_epochs"))
    early = F.when(F.col("o_orderstatus") == "F", F.lit(2))
    fine_tuned = orders.select(
        F.concat(F.lit("status "), "o_orderstatus").alias("fine_tuned_model"),
        priority,
        early.alias("pretrained_epoch"),
    ).distinct()
    return study.experiment_grid(pretrained, fine_tuned, FOLDERS)


def _measured(run):
    orders = trial.read(run.spark, run.folder, "orders")
    lines = trial.read(run.spark, run.folder, "lineitem")
    keys = ["fine_tuned_model", "pretrained_model", "test_label"]
    price = F.col("l_extendedprice")
    predictions = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("status "), "o_orderstatus").alias("fine_tuned_model"),
        F.col("o_orderpriority").alias("pretrained_model"),
        F.col("l_returnflag").alias("test_label"),
        (price / (price + 50000.0)).alias("prediction"),
        (F.col("l_tax") >= 0.05).cast("int").alias("label"),
    )
    return predictions.groupBy(*keys).agg(
        metrics.brier_score().alias("brier"), metrics.mean_binary_cross_entropy().alias("mean_loss")
    )


def _results(run):
    keys = ["fine_tuned_model", "pretrained_model", "test_label"]
    return study.combine_results(_grid(run), _measured(run), keys)


@query
def experiment_grid(run):
    return _grid(run)


@query
def combined_results(run):
    return _results(run)


@query
def result_summary(run):
    keys = ["pretrained_model", "fine_tuned_model", "pretrained_epoch"]
    return study.summarise_results(_results(run), keys, ["brier", "mean_loss"])


@query
def result_summary_pretrained(run):
    return study.summarise_results(_results(run), ["pretrained_model"], ["pretrained_epoch", "brier", "mean_loss"])


# Quality and cohorts

WINDOW_DAYS = 180
# Buckets of small tables; larger ones have more.
BUCKETS = 8


@query
def cohort_statistics(run):
    tables = run.tables
    return quality.cohort_statistics(
        tables["person"], tables["observation_period"], tables["visit_occurrence"], tables["condition_occurrence"]
    )


def _window_labels(run):
    return cohort.window_labels(
        run.distinct_events, run.tables["observation_period"], run.chosen_concepts, WINDOW_DAYS, run.busy, run.stage
    )


def _positive_labels(run):
    periods = run.tables["observation_period"]
    return cohort.positive_labels(run.distinct_events, periods, run.chosen_concepts, WINDOW_DAYS, run.busy)


@query
def label_prevalence(run):
    return quality.sparse_label_prevalence(_positive_labels(run), run.tables["observation_period"], run.chosen_concepts)


@query
def label_counts(run):
    return quality.label_counts(run.labels)


@query
def repeated_labels(run):
    """Customers labelled once for each order: each repetition would repeat their tokens."""
    orders = trial.read(run.spark, run.folder, "orders")
    return quality.repeated_labels(orders.select(F.col("o_custkey").alias("person_id")))


@query
def array_check(run):
    return quality.unequal_arrays(run.sequences)


@query
def dense_visits(run):
    return quality.dense_visits(run.sequences)


@query
def concept_choice(run):
    return cohort.choose_concepts(run.distinct_events, 10)


@query
def positive_labels(run):
    return _positive_labels(run)


@query
def window_labels(run):
    return _window_labels(run)


@query
def history_events(run):
    return cohort.history(
        run.distinct_events.select("person_id", "concept_id", "start_date"),
        "start_date",
        run.tables["observation_period"],
        WINDOW_DAYS,
        run.busy,
    )


@query
def visit_types(run):
    return cohort.visit_types(run.linked.events, F.col("concept_id") % 10 == 0)


# Files: what is written comes back


def _folder(run, name):
    """A new folder below the run's staged tables."""
    return f"{Staging(run.spark).folder}/{name}"


@query
def cdm_files(run):
    root = _folder(run, "cdm")
    write_cdm(run.tables, root)
    read = read_cdm(run.spark, root)
    counts = [
        frame.agg(F.count("*").alias("n"), F.count_distinct("person_id").alias("persons")).select(
            F.lit(name).alias("table_name"), "n", "persons"
        )
        for name, frame in read.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def cdm_visit_file(run):
    """The rows of a table that was written and read, one by one."""
    root = _folder(run, "cdm")
    write_cdm({"visit_occurrence": run.tables["visit_occurrence"]}, root)
    return read_cdm(run.spark, root)["visit_occurrence"]


def _bucketed(run):
    """What linking by date reads, bucketed by person."""
    root, prefix = _folder(run, "bucketed"), f"ehrseq_{uuid.uuid4().hex}"
    names = ["drug_exposure", "visit_occurrence", "linked_by_id"]
    number = buckets.buckets_for(max(run.person_rows.rows[n] for n in ("events", "visits")), BUCKETS)
    buckets.write_cdm_bucketed({n: run.tables[n] for n in names[:2]}, root, prefix, number)
    buckets.write_bucketed({"linked_by_id": run.linked_by_id}, root, prefix, number)
    return buckets.read_bucketed(run.spark, root, prefix, names)


@query
def bucketed_drug_table(run):
    return _bucketed(run)["drug_exposure"]


@query
def bucketed_link_by_date(run):
    """Without any shuffle after the tables are written."""
    tables = _bucketed(run)
    return visits.link_by_date(tables["linked_by_id"], visits.key_visits(tables["visit_occurrence"]), cut_by_person=True)


@query
def bucketed_sequences(run):
    root, prefix = _folder(run, "bucketed"), f"ehrseq_{uuid.uuid4().hex}"
    number = buckets.buckets_for(run.person_rows.rows["events"], BUCKETS)
    buckets.write_sequences_bucketed(run.sequences, root, prefix, number)
    return buckets.read_bucketed(run.spark, root, prefix, [SEQUENCE_TABLE])[SEQUENCE_TABLE]


@query
def label_files(run):
    path = _folder(run, "labels")
    write_labels(_window_labels(run), path)
    return read_all_labels(run.spark, path)


@query
def processed_sequences(run):
    """A CDM folder to sequences in one go, as a user runs it."""
    root, out = _folder(run, "cdm"), _folder(run, "processed")
    write_cdm(run.tables, root)
    process_cdm_data(run.spark, root, out, run.settings)
    return files.read_sequences(run.spark, f"{out}/sequences").drop("part", "last_visit_start")


@query
def sequence_files(run):
    path = _folder(run, "sequences")
    files.write_sequences(collect_sequences(run.tokens), path)
    return files.read_sequences(run.spark, path)


@query
def vocabulary_files(run):
    path = _folder(run, "vocabulary")
    files.export_vocabulary_json(run.vocabulary, path)
    return files.import_vocabulary_json(run.spark, path)


@query
def metric_files(run):
    """One metric file per test label, found again by their place in one scan."""
    root = _folder(run, "study")
    keys = ["fine_tuned_model", "pretrained_model"]
    measured = run.stage(_measured(run), f"measured-{uuid.uuid4().hex}")
    for _, label in FOLDERS:
        one = measured.where(F.col("test_label") == label).drop("test_label")
        files.write_metrics(one, f"{root}/eval_study/evaluation{label}")
    columns = ", ".join([f"{k} string" for k in keys] + ["brier double", "mean_loss double"])
    return files.scan_results(run.spark, root, columns)


@query
def settings_record(run):
    """The settings kept beside an output, with the number of events they concern."""
    path = _folder(run, "settings")
    files.write_record(run.spark, run.settings, path)
    settings = files.read_record(run.spark, type(run.settings), path)
    return run.distinct_events.agg(
        F.count("*").alias("events"),
        F.lit(settings.map_drugs_to_ingredients).alias("map_drugs_to_ingredients"),
        F.lit(settings.missing_visit_concept_id).alias("missing_visit_concept_id"),
    )
