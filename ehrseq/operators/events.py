"""Event preparation: from domain tables to one clean event table."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrseq.functions.dates import date_of_birth
from ehrseq.operators.sizes import join_lookup
from ehrseq.schema import CONCEPT_COLUMN, DEATH_CONCEPT_ID, EVENT_COLUMNS, START_DATE_COLUMN
from ehrseq.staging import like_measured


def add_date_of_birth(person: DataFrame) -> DataFrame:
    birth = date_of_birth(F.col("year_of_birth"), F.col("month_of_birth"), F.col("day_of_birth"))
    return person.withColumn("date_of_birth", birth)


def domain_events(table: DataFrame, domain: str) -> DataFrame:
    """The rows of one domain table under the common column names."""
    if domain == "death":
        concept, visit = F.lit(DEATH_CONCEPT_ID), F.lit(None)
    else:
        concept, visit = F.col(CONCEPT_COLUMN[domain]), F.col("visit_occurrence_id")
    return table.select(
        F.col("person_id").cast("bigint"),
        F.col(START_DATE_COLUMN[domain]).cast("date").alias("start_date"),
        concept.cast("bigint").alias("concept_id"),
        visit.cast("bigint").alias("visit_occurrence_id"),
    )


def union_domain_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """All events of the domain tables that are present. Deaths get their own concept."""
    events = [domain_events(tables[d], d) for d in START_DATE_COLUMN if d in tables]
    return reduce(DataFrame.unionByName, events)


def unwanted(concept_ids: list[int]) -> Column:
    """Whether an event's concept is to be removed; an event without a concept is not."""
    return F.coalesce(F.col("concept_id").isin(list(concept_ids)), F.lit(False))


def remove_concepts(events: DataFrame, concept_ids: list[int]) -> DataFrame:
    """Drop unwanted concepts; an event without a concept stays."""
    return events.where(~unwanted(concept_ids))


def count_removed(events: DataFrame, concept_ids: list[int]) -> DataFrame:
    """How many events ``remove_concepts`` removes and keeps, in one pass, as a one-row frame."""
    return events.agg(
        F.count_if(unwanted(concept_ids)).alias("removed_concepts"), F.count_if(~unwanted(concept_ids)).alias("kept")
    )


def remove_duplicates(events: DataFrame) -> DataFrame:
    """One row per distinct event. Copies collapse in the map tasks, before the shuffle."""
    return events.select(*EVENT_COLUMNS).distinct()


def count_copies(events: DataFrame, concept_ids: list[int]) -> DataFrame:
    """One row per distinct event that stays, with its ``copies``; all unwanted ones share one ``unwanted`` row.

    So what cleaning removes can be counted from its written result. Copies and unwanted events
    collapse in the map tasks.
    """
    marked = events.withColumn("unwanted", unwanted(concept_ids))
    kept = [F.when(~F.col("unwanted"), F.col(c)).alias(c) for c in EVENT_COLUMNS]
    return marked.select(*kept, "unwanted").groupBy(*EVENT_COLUMNS, "unwanted").agg(F.count("*").alias("copies"))


def stage_distinct_events(events: DataFrame, concept_ids: list[int], stage) -> DataFrame:
    """The result of ``remove_concepts`` and ``remove_duplicates`` as a staged table that also knows
    what they removed."""
    gone = F.coalesce(F.sum(F.when(F.col("unwanted"), F.col("copies"))), F.lit(0))
    copies = F.coalesce(F.sum(F.when(~F.col("unwanted"), F.col("copies") - 1)), F.lit(0))
    counted = stage.measured(
        count_copies(events, concept_ids), "distinct_events", {"removed_concepts": gone, "removed_duplicates": copies}
    )
    return like_measured(counted.where(~F.col("unwanted")).select(*EVENT_COLUMNS), counted)


def ingredients(concept: DataFrame) -> DataFrame:
    return concept.where(F.col("concept_class_id") == "Ingredient").select("concept_id")


def ingredient_mapping(concept: DataFrame, concept_ancestor: DataFrame) -> DataFrame:
    """Drug concept to the ingredients among its ancestors; possibly several."""
    return concept_ancestor.join(
        ingredients(concept), F.col("ancestor_concept_id") == F.col("concept_id")
    ).select(
        F.col("descendant_concept_id").alias("source_concept_id"),
        F.col("ancestor_concept_id").alias("target_concept_id"),
    )


def map_concepts(table: DataFrame, concept_column: str, mapping: DataFrame) -> DataFrame:
    """Replace a concept by its targets: unmapped rows go, rows with several targets multiply."""
    others = [c for c in table.columns if c != concept_column]
    joined = join_lookup(table, mapping, table[concept_column] == mapping["source_concept_id"], "inner")
    return joined.select(*others, F.col("target_concept_id").alias(concept_column))
