"""One run of the jobs over trial tables, shared by the queries that need its results.

Each property is a lazy frame or a staged table that Spark derives from the given tables.
"""

from functools import cached_property

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ehrseq.operators.cohort import choose_concepts
from ehrseq.operators.events import stage_distinct_events
from ehrseq.operators.sequences import collect_sequences
from ehrseq.operators.tokens import rank_visits, token_stream
from ehrseq.operators.visits import key_visits, link_by_id
from ehrseq.operators.vocabulary import fit_vocabulary, split_by_person
from ehrseq.plans.process import count_rows, link_prepared, prepare_events, run_counters, stage_mapping
from ehrseq.settings import MappingSettings
from ehrseq.sources import trial
from ehrseq.staging import Staging

TRAIN_FRACTION = 0.8
SEED = 7


class TrialRun:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.settings = MappingSettings()
        self.stage = Staging(spark)
        self.tables = trial.cdm_tables(spark, folder)
        self.labels = trial.labels(spark, folder)

    @cached_property
    def mapping(self):
        return stage_mapping(self.tables, self.stage)

    @cached_property
    def events(self):
        return prepare_events(self.tables, self.settings, self.mapping)

    @cached_property
    def distinct_events(self):
        return stage_distinct_events(self.events["union"], self.settings.concepts_to_remove, self.stage)

    @cached_property
    def keyed_visits(self):
        return self.stage.measured(key_visits(self.tables["visit_occurrence"], self.busy), "keyed_visits")

    @cached_property
    def person_rows(self):
        return count_rows(self.tables, self.distinct_events, self.stage)

    @property
    def busy(self):
        return self.person_rows.busy

    @cached_property
    def linked_by_id(self):
        return link_by_id(self.distinct_events, self.keyed_visits)

    @cached_property
    def linked(self):
        return link_prepared(self.tables, self.distinct_events, self.person_rows, self.settings, self.stage, self.keyed_visits)

    def ranked(self, labels=None):
        return rank_visits(
            self.linked.visits,
            self.tables["observation_period"],
            self.tables["person"],
            self.linked.events,
            labels,
            self.busy,
            stage=self.stage,
            meet_by_person=True,
        )

    @cached_property
    def ranked_visits(self):
        return self.stage(self.ranked(), "ranked_visits")

    @cached_property
    def ranked_labelled_visits(self):
        return self.stage(self.ranked(self.labels), "ranked_labelled_visits")

    @cached_property
    def tokens(self):
        return self.stage(token_stream(self.linked.events, self.ranked_visits), "tokens")

    @cached_property
    def labelled_tokens(self):
        return self.stage(token_stream(self.linked.events, self.ranked_labelled_visits), "labelled_tokens")

    @cached_property
    def sequences(self):
        return self.stage(collect_sequences(self.tokens), "sequences")

    @cached_property
    def counters(self):
        return run_counters(self.distinct_events, self.person_rows, self.linked)

    @cached_property
    def training_tokens(self):
        return split_by_person(self.tokens, TRAIN_FRACTION, SEED)[0]

    @cached_property
    def vocabulary(self):
        return self.stage.measured(fit_vocabulary(self.training_tokens, "concept_ids"), "vocabulary")

    @cached_property
    def visit_vocabulary(self):
        return self.stage.measured(fit_vocabulary(self.training_tokens, "visit_concept_ids"), "visit_vocabulary")

    @cached_property
    def chosen_concepts(self):
        return self.stage.measured(choose_concepts(self.distinct_events, 10), "chosen_concepts")

    @cached_property
    def predictions(self):
        """Order lines as predictions: the score rises with the price and repeats across lines."""
        price = F.col("l_extendedprice")
        return trial.read(self.spark, self.folder, "lineitem").select(
            F.col("l_returnflag").alias("pretrained_model"),
            F.col("l_linestatus").alias("fine_tuned_model"),
            (price / (price + 50000.0)).alias("prediction"),
            (F.col("l_tax") >= 0.05).cast("int").alias("label"),
        )

    @cached_property
    def logits(self):
        return trial.read(self.spark, self.folder, "embeddings").select(
            F.col("vec_id"),
            F.col("embedding").cast("array<double>").alias("logits"),
            F.col("label").cast("bigint").alias("target"),
        )


_RUNS: dict[tuple[str, str], TrialRun] = {}


def trial_run(spark: SparkSession, folder: str) -> TrialRun:
    """The run for this application and folder; a later query shares its staged tables."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _RUNS:
        _RUNS[key] = TrialRun(spark, folder)
    return _RUNS[key]


def forget_runs() -> None:
    """Start afresh, so that a timing includes all the work."""
    _RUNS.clear()
