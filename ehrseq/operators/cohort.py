"""Prediction problems from event tables: which concepts, which labels, which history."""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrseq.operators.numbering import number_rows
from ehrseq.operators.ranges import within_period
from ehrseq.operators.sizes import join_lookup
from ehrseq.schema import EMERGENCY_VISIT, GENDER_FEMALE, GENDER_MALE, OUTPATIENT_VISIT
from ehrseq.staging import Staging, measured

# Concepts numbered, and laid out beside a period, at a time; order work only.
CONCEPTS_PER_BLOCK = 10_000


def gender_concept(state: Column) -> Column:
    return F.when(state == 0, F.lit(GENDER_MALE)).otherwise(F.lit(GENDER_FEMALE))


def choose_concepts(concepts: DataFrame, how_many: int) -> DataFrame:
    """``how_many`` concepts spread evenly over the ordered list of distinct concepts.

    The places are those of an even grid from the first to the last, halves rounded to even.
    Each concept checks by itself whether a grid point rounds to its place.
    """
    distinct = concepts.select("concept_id").where("concept_id IS NOT NULL").distinct()
    blocks = distinct.withColumn("_all", F.lit(0)).withColumn(
        "_block", F.floor(F.col("concept_id") / CONCEPTS_PER_BLOCK)
    )
    placed = number_rows(blocks, "_number", ["_all"], "_block", ["concept_id"])
    place = F.col("_number") - 1
    last = F.col("_last")
    step = last / F.lit(float(max(how_many - 1, 1)))
    # The grid points that can round to a place lie half a place around it; past the first two
    # there are only more of the same.
    first = F.ceil((place - 0.5) / step)
    near = [F.greatest(first, F.lit(0)), first + 1]
    on_grid = [(point < how_many) & (F.bround(point * step) == place) for point in near]
    return (
        placed.withColumn("_last", distinct.agg(F.count("*") - 1).scalar())
        .where(F.when(last == 0, F.lit(True)).otherwise(on_grid[0] | on_grid[1]))
        .select("concept_id")
    )


def index_date(window_days: int) -> Column:
    """The last day of history: the period's end less the prediction window."""
    return F.date_sub("observation_period_end_date", window_days)


def positive_labels(
    events: DataFrame,
    observation_period: DataFrame,
    concepts: DataFrame,
    window_days: int,
    busy: DataFrame | None = None,
) -> DataFrame:
    """(person_id, observation_period_id, concept_id): the chosen concepts that occur after the index date.

    The sparse form of labels: with the lists of periods and concepts it says all, since every pair
    that is not here is a negative. It grows with the events, however many concepts are predicted.
    ``concepts`` should be a staged table of distinct ``concept_id``.
    """
    wanted = join_lookup(events, concepts, "concept_id", "left_semi")
    inside = within_period(wanted.select("person_id", "concept_id", "start_date"), "start_date", observation_period, busy)
    after = inside.where(F.col("start_date") > index_date(window_days))
    return after.select("person_id", "observation_period_id", "concept_id").distinct()


def list_concepts(concepts: DataFrame, stage: Staging) -> DataFrame:
    """The different concepts of ``concepts`` as a staged table."""
    return stage.measured(concepts.select("concept_id").where("concept_id IS NOT NULL").distinct(), f"concepts_{uuid.uuid4().hex}")


def concept_blocks(concepts: DataFrame, per_block: int, stage: Staging) -> DataFrame:
    """(block from 0, its sorted ``concept_ids``), at most ``per_block`` in each."""
    keyed = concepts.withColumn("_all", F.lit(0)).withColumn("_range", F.floor(F.col("concept_id") / CONCEPTS_PER_BLOCK))
    numbered = number_rows(keyed, "_number", ["_all"], "_range", ["concept_id"])
    block = F.floor((F.col("_number") - 1) / per_block).alias("block")
    lists = numbered.groupBy(block).agg(F.sort_array(F.collect_list("concept_id")).alias("concept_ids"))
    return stage.measured(lists, f"concept_blocks_{uuid.uuid4().hex}")


def window_labels(
    events: DataFrame,
    observation_period: DataFrame,
    concepts: DataFrame,
    window_days: int,
    busy: DataFrame | None = None,
    stage: Staging | None = None,
    concepts_per_block: int = CONCEPTS_PER_BLOCK,
) -> DataFrame:
    """Whether each concept occurs after the index date, for every period and chosen concept.

    The dense form of ``positive_labels``: a row for every period and concept, as the definition has
    it, for any number of concepts. Periods meet blocks of concepts by block number, so no row holds
    more than a block.
    """
    stage = stage or Staging(events.sparkSession)
    listed = list_concepts(concepts, stage)
    blocks = concept_blocks(listed, concepts_per_block, stage)
    positives = positive_labels(events, observation_period, listed, window_days, busy).withColumn("_hit", F.lit(True))
    # Empty when no concept is chosen.
    numbers = F.sequence(F.lit(0), F.lit(measured(blocks).rows - 1)) if measured(blocks).rows else F.array().cast("array<int>")
    periods = observation_period.select("person_id", "observation_period_id", F.explode(numbers.cast("array<bigint>")).alias("block"))
    wide = join_lookup(periods, blocks, "block", "inner").select(
        "person_id", "observation_period_id", F.explode("concept_ids").alias("concept_id")
    )
    return wide.join(positives, ["person_id", "observation_period_id", "concept_id"], "left").select(
        "person_id",
        "observation_period_id",
        "concept_id",
        F.coalesce("_hit", F.lit(False)).alias("label"),
    )


def history(
    rows: DataFrame,
    date: str,
    observation_period: DataFrame,
    window_days: int,
    busy: DataFrame | None = None,
) -> DataFrame:
    """Rows of each period up to and including its index date."""
    inside = within_period(rows, date, observation_period, busy)
    return inside.where(F.col(date) <= index_date(window_days)).drop(
        "observation_period_start_date", "observation_period_end_date"
    )


def visit_types(events: DataFrame, serious: Column) -> DataFrame:
    """Emergency for visits with a serious concept, outpatient for all others."""
    kind = F.when(F.bool_or(serious), F.lit(EMERGENCY_VISIT)).otherwise(F.lit(OUTPATIENT_VISIT))
    return events.groupBy("visit_person_id", "visit_seq").agg(kind.cast("bigint").alias("visit_concept_id"))
