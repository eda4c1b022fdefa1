"""Cohort statistics and checks of finished sequences."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrseq.schema import EMERGENCY_VISIT, PERIOD_KEY, SEQUENCE_ARRAYS


def cohort_statistics(person: DataFrame, observation_period: DataFrame, visits: DataFrame, conditions: DataFrame) -> DataFrame:
    """Persons, visits, days per visit, concepts per visit, distinct concepts, emergency share."""
    days = F.sum(F.datediff("observation_period_end_date", "observation_period_start_date"))
    visit_count = F.count("*").cast("double")
    observed = observation_period.agg(days).scalar()
    return visits.agg(
        person.agg(F.count("*")).scalar().alias("persons"),
        F.count("*").alias("visits"),
        (observed / visit_count).alias("mean_days_between_visits"),
        (conditions.agg(F.count("*")).scalar() / visit_count).alias("mean_concepts_per_visit"),
        conditions.agg(F.count_distinct("condition_concept_id")).scalar().alias("unique_concepts"),
        (100 * F.count_if(F.col("visit_concept_id") == EMERGENCY_VISIT) / visit_count).alias("percent_er_visits"),
    )


def label_prevalence(labels: DataFrame) -> DataFrame:
    """Mean over the predicted concepts of each one's share of positives, in percent."""
    per_concept = labels.groupBy("concept_id").agg(F.avg(F.col("label").cast("double")).alias("_share"))
    return per_concept.agg((100 * F.avg("_share")).alias("percent_positive"))


def sparse_label_prevalence(positives: DataFrame, periods: DataFrame, concepts: DataFrame) -> DataFrame:
    """``label_prevalence`` from the positives alone; every other pair of a period and a concept is
    a negative, and is never laid out."""
    found = positives.groupBy("concept_id").agg(F.count("*").alias("_positives"))
    share = F.coalesce("_positives", F.lit(0)) / F.col("_periods")
    shares = concepts.select("concept_id").join(found, "concept_id", "left").withColumn("_periods", periods.agg(F.count("*")).scalar())
    return shares.agg((100 * F.avg(share)).alias("percent_positive"))


def unequal_arrays(sequences: DataFrame) -> DataFrame:
    """For each array: the sequences, and those whose rows together hold more or fewer values than
    the sequence says."""
    names = [n for n in SEQUENCE_ARRAYS if n != "visit_concept_ids"]
    whole = sequences.groupBy(*PERIOD_KEY).agg(
        F.max("num_of_concepts").alias("_said"), *[F.sum(F.size(n)).alias(n) for n in names]
    )
    counts = [F.struct(F.lit(n).alias("array"), F.count_if(F.col(n) != F.col("_said")).alias("unequal")) for n in names]
    totals = whole.agg(F.count("*").alias("sequences"), F.array(*counts).alias("_counts"))
    return totals.select("sequences", F.explode("_counts").alias("_c")).select("_c.array", "sequences", "_c.unequal")


def dense_visits(sequences: DataFrame) -> DataFrame:
    """Visits in all, and visits in sequences with more than one visit per two days.

    The week 0 of interval tokens counts as a date, as in the published check.
    """
    per_sequence = sequences.groupBy(*PERIOD_KEY).agg(
        ((F.max(F.array_max("dates")) - F.min(F.array_min("dates"))) * 7).alias("_days"),
        F.max(F.array_max("visit_concept_orders")).alias("_visits"),
    )
    dense = F.when(F.col("_visits") > F.col("_days") / 2, F.col("_visits")).otherwise(0)
    totals = per_sequence.agg(F.sum("_visits").alias("total_visits"), F.sum(dense).alias("dense_visits"))
    return totals.withColumn("dense_share", F.col("dense_visits") / F.col("total_visits"))


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def repeated_labels(labels: DataFrame) -> DataFrame:
    """Persons labelled more than once; each repetition repeats all their tokens."""
    return labels.groupBy("person_id").agg(F.count("*").alias("n")).where("n > 1")
