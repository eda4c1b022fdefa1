"""Joins of dated rows to date ranges of the same person, without pairing all with all.

``busy`` names the persons whose rows must not meet in one group; for them the joins work on
parts of the calendar.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ehrseq.functions.dates import month_number
from ehrseq.operators.numbering import add_block, carry_in, month_block, visit_block
from ehrseq.operators.sizes import cut, known_rows

RANGE_TYPE = "struct<first_date:date,last_date:date,visit_seq:bigint>"


def within_period(rows: DataFrame, date: str, periods: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """Rows whose date lies inside an observation period of their person (ends included).

    A row inside two overlapping periods comes out twice, with all columns of each. Rows and
    periods of busy persons meet per calendar month: a period is listed once per month between the
    person's first and last row, so an open-ended period does not grow without bound.
    """
    inside = (F.col(date) >= F.col("observation_period_start_date")) & (
        F.col(date) <= F.col("observation_period_end_date")
    )
    if busy is None:
        return rows.join(periods, "person_id").where(inside)
    cut = add_block(rows, busy, month_number(F.col(date)), "_month")
    active = cut.where("_month <> 0").groupBy("person_id").agg(
        F.min("_month").alias("_first"), F.max("_month").alias("_last")
    )
    first = F.greatest(month_number(F.col("observation_period_start_date")), F.col("_first"))
    last = F.least(month_number(F.col("observation_period_end_date")), F.col("_last"))
    listed = (
        F.when(F.col("_first").isNull(), F.array(F.lit(0)))
        .when(first <= last, F.sequence(first, last))
        .otherwise(F.array().cast("array<int>"))
    )
    by_month = (
        periods.join(active, "person_id", "left").withColumn("_month", F.explode(listed)).drop("_first", "_last")
    )
    return cut.join(by_month, ["person_id", "_month"]).where(inside).drop("_month")


def _cut_keys(busy: DataFrame | None) -> list[str]:
    return ["person_id"] if busy is None else ["person_id", "_block"]


def exclusive_ranges(visits: DataFrame, busy: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """For each person, the dates on which a visit is the first (in visit order) to cover them.

    A visit can be the first to cover a date only past the end of every visit before it. That
    leaves disjoint ranges: a date has at most one. Visits that never reach past their
    predecessors drop out. ``rows``, the number of visits, lets them be cut finely; without it no row is moved but
    as the windows need.
    """
    visits = visit_block(
        visits.where(
            F.col("person_id").isNotNull() & (F.col("visit_start_date") <= F.col("visit_end_date"))
        ).select("person_id", "visit_seq", "visit_start_date", "visit_end_date"),
        busy,
    )
    visits = cut(visits, rows, *_cut_keys(busy))
    earlier = (
        Window.partitionBy("person_id", "_block").orderBy("visit_seq").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = carry_in(visits, busy, ["person_id"], "_carried", F.col("visit_end_date"), "date")
    return (
        carried.withColumn("_covered", F.greatest("_carried", F.max("visit_end_date").over(earlier)))
        .where(F.col("_covered").isNull() | (F.col("visit_end_date") > F.col("_covered")))
        .select(
            "person_id",
            F.greatest("visit_start_date", F.date_add("_covered", 1)).alias("first_date"),
            F.col("visit_end_date").alias("last_date"),
            "visit_seq",
        )
    )


def first_covering_visit(days: DataFrame, visits: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """The first visit (in visit order) of the person that covers each (person, date), or null.

    ``days`` holds distinct ``person_id, start_date``. The ranges are disjoint, so the range that
    began last on or before a date is the only candidate: one pass over days and ranges in date
    order finds it.
    """
    person = F.col("person_id")
    ranges = exclusive_ranges(visits, busy, known_rows(visits)).select(
        person,
        F.col("first_date").alias("_date"),
        F.struct("first_date", "last_date", "visit_seq").alias("_range"),
        F.lit(0).alias("_is_day"),
    )
    probes = days.select(
        person, F.col("start_date").alias("_date"), F.lit(None).cast(RANGE_TYPE).alias("_range"), F.lit(1).alias("_is_day")
    )
    line = cut(month_block(ranges.unionByName(probes), busy, "_date"), known_rows(days, visits), *_cut_keys(busy))
    up_to_here = (
        Window.partitionBy("person_id", "_block")
        .orderBy("_date", "_is_day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = carry_in(line, busy, ["person_id"], "_carried", F.col("_range"), RANGE_TYPE)
    candidate = F.coalesce(F.last("_range", ignorenulls=True).over(up_to_here), "_carried")
    return (
        carried.withColumn("_candidate", candidate)
        .where(F.col("_is_day") == 1)
        .select(
            "person_id",
            F.col("_date").alias("start_date"),
            F.when(F.col("_date") <= F.col("_candidate.last_date"), F.col("_candidate.visit_seq")).alias("visit_seq"),
        )
    )


def first_covering_visit_in_place(days: DataFrame, visits: DataFrame) -> DataFrame:
    """``first_covering_visit`` for inputs that are cut by person already: no row leaves its partition.

    Days and ranges of a person meet per calendar month, by a join in place of the union above. The
    ranges are disjoint and the days distinct, so a month has a month's days of each at most. A
    range is listed for the months between the person's first and last day.
    """
    active = days.groupBy("person_id").agg(F.min("start_date").alias("_first"), F.max("start_date").alias("_last"))
    ranges = exclusive_ranges(visits).join(active, "person_id")
    since, until = F.greatest("first_date", "_first"), F.least("last_date", "_last")
    listed = ranges.where(since <= until).select(
        "person_id", "first_date", "last_date", "visit_seq", F.explode(F.sequence(month_number(since), month_number(until))).alias("_month")
    )
    probes = days.withColumn("_month", month_number(F.col("start_date")))
    inside = (F.col("start_date") >= F.col("first_date")) & (F.col("start_date") <= F.col("last_date"))
    same = (probes["person_id"] == listed["person_id"]) & (probes["_month"] == listed["_month"])
    return probes.join(listed, same & inside, "left").select(probes["person_id"], "start_date", "visit_seq")
