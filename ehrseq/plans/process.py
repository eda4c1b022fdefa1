"""From CDM tables to token and sequence tables."""

from dataclasses import asdict
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ehrseq.operators.events import (
    ingredient_mapping,
    map_concepts,
    remove_concepts,
    remove_duplicates,
    stage_distinct_events,
    union_domain_tables,
)
from ehrseq.operators.numbering import PersonRows, count_person_rows
from ehrseq.operators.sequences import collect_sequences
from ehrseq.operators.tokens import create_tokens
from ehrseq.operators.visits import LinkedEvents, link_events_to_visits, one_row
from ehrseq.schema import CDM_SCHEMA
from ehrseq.settings import MappingSettings
from ehrseq.sources.cdm import read_cdm, read_labels, read_table
from ehrseq.sources.files import write_record, write_sequences
from ehrseq.staging import ResumableStaging, Staging, identity_of, measured, output_exists


class Processed(NamedTuple):
    tokens: DataFrame
    counters: DataFrame


def stage_mapping(tables: dict[str, DataFrame], stage: Staging) -> DataFrame:
    """The ingredients of each drug, computed once; joins to it know its size from the write."""
    return stage.measured(ingredient_mapping(tables["concept"], tables["concept_ancestor"]), "ingredient_mapping")


def prepare_events(
    tables: dict[str, DataFrame], settings: MappingSettings, mapping: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Events after each cleaning step, under the step's name. ``mapping`` is needed to map drugs."""
    tables = dict(tables)
    if settings.map_drugs_to_ingredients and "drug_exposure" in tables:
        tables["drug_exposure"] = map_concepts(tables["drug_exposure"], "drug_concept_id", mapping)
    union = union_domain_tables(tables)
    kept = remove_concepts(union, settings.concepts_to_remove)
    return {"union": union, "kept": kept, "distinct": remove_duplicates(kept)}


def process_tables(
    tables: dict[str, DataFrame],
    settings: MappingSettings,
    labels: DataFrame | None = None,
    stage: Staging | None = None,
) -> Processed:
    """Clean events, attach them to visits and lay them out as tokens, for all persons at once."""
    stage = stage or Staging(tables["person"].sparkSession)
    # Small tables that are needed to the end are read once.
    tables = tables | {name: stage(tables[name], name) for name in ("person", "observation_period")}
    labels = stage(labels, "labels") if settings.has_labels else None
    maps = settings.map_drugs_to_ingredients and "drug_exposure" in tables
    events = prepare_events(tables, settings, stage_mapping(tables, stage) if maps else None)
    distinct = stage_distinct_events(events["union"], settings.concepts_to_remove, stage)
    persons = count_rows(tables, distinct, stage)
    linked = link_prepared(tables, distinct, persons, settings, stage)
    tokens = create_tokens(
        tables, linked.events, linked.visits, labels, persons.busy, stage
    )
    return Processed(tokens, run_counters(distinct, persons, linked))


def count_rows(tables: dict[str, DataFrame], distinct: DataFrame, stage: Staging) -> PersonRows:
    """Rows per table, and the busy persons of all."""
    counted = {
        "events": distinct,
        "visits": tables["visit_occurrence"],
        "observation_periods": tables["observation_period"],
        "persons": tables["person"],
    }
    return count_person_rows(counted, stage)


def link_prepared(
    tables: dict[str, DataFrame],
    distinct: DataFrame,
    persons: PersonRows,
    settings: MappingSettings,
    stage: Staging,
    keyed: DataFrame | None = None,
) -> LinkedEvents:
    missing = settings.missing_visit_concept_id
    return link_events_to_visits(distinct, tables["visit_occurrence"], missing, persons.busy, stage, persons.rows["visits"], keyed)


def run_counters(distinct: DataFrame, persons: PersonRows, linked: LinkedEvents) -> DataFrame:
    """What the run read, removed and linked, as one row. All of it was counted from the staged
    tables when they were written: no source is read again."""
    rows = {name: persons.rows[name] for name in ("persons", "observation_periods")}
    found = linked.statistics.first().asDict()
    return one_row(distinct.sparkSession, rows | measured(distinct).values | found)


def process_cdm_data(
    spark: SparkSession,
    cdm_path: str,
    output_path: str,
    settings: MappingSettings,
    label_path: str | None = None,
    label_concept_id: int | None = None,
) -> DataFrame:
    """Read a CDM folder; write ``tokens``, ``sequences``, ``counters`` and the ``settings`` used.

    Returns the counters. Intermediate tables stand in ``_staged`` below the output until the run is
    finished. A run that was stopped is taken up by the same call: tables it had finished are not
    computed again, nor are the sources read again that only they need. With other settings or
    changed source files everything is done anew. A finished output is not written over.
    """
    tables = read_cdm(spark, cdm_path)
    if settings.map_drugs_to_ingredients:
        for name in ("concept", "concept_ancestor"):
            tables[name] = read_table(spark, cdm_path, name)
    labels = read_labels(spark, label_path, label_concept_id) if settings.has_labels else None
    folders = [f"{cdm_path}/{name}" for name in CDM_SCHEMA] + ([label_path] if settings.has_labels else [])
    identity = identity_of(spark, asdict(settings) | {"label": label_concept_id}, folders)
    stage = ResumableStaging(spark, f"{output_path}/_staged", identity)
    if stage.is_new() and output_exists(spark, f"{output_path}/settings"):
        raise FileExistsError(f"{output_path} holds the output of a finished run")
    stage.finish(lambda: write_record(spark, settings, f"{output_path}/settings", "overwrite"), "settings")
    result = process_tables(tables, settings, labels, stage)
    stage.finish(lambda: result.tokens.write.mode("overwrite").parquet(f"{output_path}/tokens"), "tokens")
    stage.finish(lambda: result.counters.write.mode("overwrite").parquet(f"{output_path}/counters"), "counters")
    tokens = spark.read.parquet(f"{output_path}/tokens")
    write_sequences(collect_sequences(tokens), f"{output_path}/sequences", "overwrite")
    stage.delete()
    return spark.read.parquet(f"{output_path}/counters")
