"""Attaching every event to a visit."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ehrseq.operators.numbering import add_block, number_rows
from ehrseq.operators.ranges import first_covering_visit, first_covering_visit_in_place
from ehrseq.operators.sizes import cut, known_rows
from ehrseq.staging import Staging, like_measured, measured

# Room for the visits of one person that start on the same day.
SEQ_PER_DAY = 2**32
# Visit ids per block when a busy person's visits of one day are numbered; orders work only.
IDS_PER_BLOCK = 100_000
# Into how many groups the events of a busy person's day are spread; orders work only.
SPREAD = 64


class LinkedEvents(NamedTuple):
    events: DataFrame
    visits: DataFrame
    statistics: DataFrame


def day_seq(date: Column) -> Column:
    """Lowest visit key of a day; a visit without a start date comes before all others."""
    days = F.coalesce(F.datediff(date, F.lit("1970-01-01").cast("date")), F.lit(-(2**30)))
    return days.cast("bigint") * SEQ_PER_DAY


def key_visits(visits: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """Add ``visit_seq``: unique per person and increasing in (start, end, id) of the visit.

    The key is the start day and a number within that day, so visits of one person are numbered
    day by day and never in one window. A busy person's day is cut by end date and visit id.
    """
    order = ["visit_end_date", "visit_occurrence_id"]
    day = day_seq(F.col("visit_start_date"))
    if busy is None:
        same_day = Window.partitionBy("person_id", "visit_start_date").orderBy(*order)
        return visits.withColumn("visit_seq", day + F.row_number().over(same_day))
    cut = add_block(visits.withColumn("_day", day), busy, F.lit(1), "_busy_person")
    is_busy = F.col("_busy_person") == 1
    end = F.when(is_busy, day_seq(F.col("visit_end_date"))).otherwise(F.lit(0))
    ids = F.when(is_busy, F.floor(F.coalesce("visit_occurrence_id", F.lit(-(2**63))) / IDS_PER_BLOCK)).otherwise(F.lit(0))
    numbered = number_rows(
        cut.withColumn("_end", end).withColumn("_ids", ids), "_number", ["person_id", "_day"], ["_end", "_ids"], order
    )
    return numbered.select(*visits.columns, (F.col("_day") + F.col("_number")).alias("visit_seq"))


def link_by_id(events: DataFrame, keyed_visits: DataFrame) -> DataFrame:
    """Left join on the visit id alone: the visit may belong to another person.

    Adds ``id_from_id`` and the visit's own ``visit_person_id``. Events without a visit id match
    nothing and stay where they are. ``events`` should be a staged table: it is read twice.
    """
    by_id = keyed_visits.select(
        "visit_occurrence_id", F.col("person_id").alias("visit_person_id"), F.col("visit_seq").alias("id_from_id")
    ).where(F.col("visit_occurrence_id").isNotNull())
    named = events.where(F.col("visit_occurrence_id").isNotNull()).join(by_id, "visit_occurrence_id", "left")
    unnamed = events.where(F.col("visit_occurrence_id").isNull())
    nothing = {name: F.lit(None).cast("bigint") for name in ("visit_person_id", "id_from_id")}
    return like_measured(named.unionByName(unnamed.withColumns(nothing)), events)


def link_by_date(
    linked: DataFrame, keyed_visits: DataFrame, busy: DataFrame | None = None, cut_by_person: bool = False
) -> DataFrame:
    """Add the first visit covering each event's date, and collapse events that became equal.

    With ``cut_by_person`` both inputs come from tables bucketed by person, and nothing is shuffled.
    """
    distinct = linked.select("person_id", "start_date", "concept_id", "id_from_id", "visit_person_id")
    if not cut_by_person:
        distinct = cut(distinct, known_rows(linked), *distinct.columns)
    distinct = distinct.distinct()
    days = like_measured(distinct.select("person_id", "start_date").distinct(), linked)
    covering = first_covering_visit_in_place(days, keyed_visits) if cut_by_person else first_covering_visit(days, keyed_visits, busy)
    by_date = covering.withColumnRenamed("visit_seq", "id_from_date")
    return distinct.join(by_date, ["person_id", "start_date"], "left")


def unlinked_days(linked: DataFrame) -> DataFrame:
    """Person and date of the events that name no known visit."""
    days = (
        linked.where(F.col("id_from_id").isNull())
        .where(F.col("person_id").isNotNull() & F.col("start_date").isNotNull())
        .select("person_id", "start_date")
        .distinct()
    )
    return like_measured(days, linked)


def resolve_days(days: DataFrame, keyed_visits: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """Each day's visit: an existing one that covers it, else a new visit of that day.

    No visit of the person starts on a day that needs a new one, so the day's lowest key is free.
    """
    covered = first_covering_visit(days, keyed_visits, busy)
    return covered.select(
        "person_id",
        "start_date",
        F.coalesce("visit_seq", day_seq(F.col("start_date"))).alias("day_visit_seq"),
        F.col("visit_seq").isNull().alias("is_new"),
    )


def new_visits(resolved_days: DataFrame, missing_visit_concept_id: int) -> DataFrame:
    """One-day visits for days whose events belong to no visit."""
    return resolved_days.where("is_new").select(
        "person_id",
        F.col("start_date").alias("visit_start_date"),
        F.col("start_date").alias("visit_end_date"),
        F.lit(missing_visit_concept_id).cast("bigint").alias("visit_concept_id"),
        F.col("day_visit_seq").alias("visit_seq"),
    )


def resolve_events(linked: DataFrame, resolved_days: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """Events with their visit, once each, with the route by which the visit was found.

    The join on person and date also groups equal events, so removing them needs no shuffle.
    Days of busy persons are spread: equal events stay together, and the day is listed in each
    group.
    """
    by_id = F.col("id_from_id").isNotNull()
    events = linked.select("person_id", "start_date", "concept_id", "id_from_id", "visit_person_id")
    keys = ["person_id", "start_date"]
    if busy is not None:
        group = 1 + F.pmod(F.xxhash64("concept_id", "id_from_id", "visit_person_id"), F.lit(SPREAD))
        events = add_block(events, busy, group, "_spread")
        groups = F.when(F.col("_busy_day") == 1, F.sequence(F.lit(1), F.lit(SPREAD))).otherwise(F.array(F.lit(0)))
        resolved_days = (
            add_block(resolved_days, busy, F.lit(1), "_busy_day")
            .withColumn("_spread", F.explode(groups.cast("array<bigint>")))
            .drop("_busy_day")
        )
        keys = [*keys, "_spread"]
    return (
        cut(events, known_rows(linked), *keys).join(resolved_days, keys, "left")
        .distinct()
        .select(
            "person_id",
            "concept_id",
            "start_date",
            F.when(by_id, F.col("visit_person_id")).otherwise(F.col("person_id")).alias("visit_person_id"),
            F.coalesce("id_from_id", "day_visit_seq").alias("visit_seq"),
            by_id.alias("by_id"),
            F.coalesce("is_new", F.lit(False)).alias("on_new_visit_day"),
        )
    )


def link_counts() -> dict[str, Column]:
    """How resolved events found their visits.

    ``mapped_to_new_visit`` counts every event on a day that got a new visit, also those linked
    by id; ``used_new_visit`` counts those that really belong to a new visit.
    """
    by_id, new_day = F.col("by_id"), F.col("on_new_visit_day")
    return {
        "mapped_by_id": F.count_if(by_id),
        "mapped_by_date": F.count_if(~by_id & ~new_day & F.col("visit_seq").isNotNull()),
        "mapped_to_new_visit": F.count_if(new_day),
        "used_new_visit": F.count_if(new_day & ~by_id),
    }


def one_row(spark: SparkSession, values: dict[str, int]) -> DataFrame:
    """Numbers that are known already, as a frame."""
    return spark.range(1).select(*[F.lit(value or 0).cast("bigint").alias(name) for name, value in values.items()])


def link_events_to_visits(
    events: DataFrame,
    visits: DataFrame,
    missing_visit_concept_id: int = 0,
    busy: DataFrame | None = None,
    stage: Staging | None = None,
    visit_rows: int | None = None,
    keyed: DataFrame | None = None,
) -> LinkedEvents:
    """Link by visit id, else by date, else to a new visit of the event's day.

    What several of the results read is staged, so that it is computed once; the statistics are
    counted from that. ``busy`` names persons with very many rows and ``visit_rows`` is the
    number of visits (see ``count_person_rows``); ``keyed`` are the keyed visits, if they are staged.
    """
    stage = stage or Staging(events.sparkSession)
    keyed = stage.measured(key_visits(visits, busy), "keyed_visits") if keyed is None else keyed
    linked = stage.measured(link_by_id(events, keyed), "linked_events")
    days = stage.measured(resolve_days(unlinked_days(linked), keyed, busy), "resolved_days", {"new_visits": F.count_if("is_new")})
    resolved = stage.measured(resolve_events(linked, days, busy), "resolved_events", link_counts())
    all_visits = keyed.select(
        "person_id", "visit_start_date", "visit_end_date", "visit_concept_id", "visit_seq"
    ).unionByName(new_visits(days, missing_visit_concept_id))
    existing = visits.count() if visit_rows is None else visit_rows
    found = measured(resolved).values | measured(days).values | {"existing_visits": existing}
    all_visits = like_measured(all_visits, days, existing + (found["new_visits"] or 0))
    return LinkedEvents(resolved, all_visits, one_row(events.sparkSession, found))
