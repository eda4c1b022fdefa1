"""From visits and linked events to one ordered token stream per observation period.

The long form (one row per token) is an output in its own right: every later step that must not
hold a whole period in memory works on it.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ehrseq.functions.dates import age_in_months, interval_token, week_index
from ehrseq.operators.events import add_date_of_birth
from ehrseq.operators.numbering import blocks_before, visit_block
from ehrseq.operators.ranges import within_period
from ehrseq.operators.sizes import cut, known_rows
from ehrseq.schema import (
    PERIOD_KEY,
    SORT_INTERVAL,
    SORT_VISIT_END,
    SORT_VISIT_START,
    VISIT_END,
    VISIT_START,
)
from ehrseq.staging import Staging, like_measured

# A visit with more events than this is ordered in several window partitions.
LARGE_VISIT_EVENTS = 1_000_000

TOKEN_COLUMNS = [
    *PERIOD_KEY,
    "concept_ids",
    "visit_segments",
    "dates",
    "ages",
    "visit_concept_orders",
    "visit_concept_ids",
    "sort_order",
    "orders",
    "sequence_length",
    "num_of_visits",
    "last_visit_start",
]


def rank_visits(
    visits: DataFrame,
    observation_period: DataFrame,
    person: DataFrame,
    events: DataFrame,
    labels: DataFrame | None = None,
    busy: DataFrame | None = None,
    large_visit_events: int = LARGE_VISIT_EVENTS,
    stage: Staging | None = None,
    meet_by_person: bool = False,
) -> DataFrame:
    """Visits of each period with all that their tokens need.

    Adds the rank in the period, the end of the previous visit, the date of birth (null for a
    person who is not in the person table), and where the visit's tokens begin in the sequence.
    Token counts are known before any token exists: a known person's visit has a start, an end
    and its events, and every visit but the first has an interval before it.

    ``meet_by_person`` says that no input is cut by person already: visits and events are then cut so
    once, and neither the periods nor the windows move them again.
    """
    counted = _with_counts(visits, events) if meet_by_person and busy is None else _joined_with_counts(visits, events)
    # What is known of the person travels with the period, so visits meet both in one join.
    birth = add_date_of_birth(person).select("person_id", "date_of_birth", F.lit(True).alias("known_person"))
    periods = observation_period.join(birth, "person_id", "left")
    if labels is not None:
        periods = periods.join(_person_labels(labels), "person_id")
    known = F.coalesce("known_person", F.lit(False))
    label = [] if labels is None else ["label", "_copies"]
    counted = within_period(counted, "visit_start_date", periods, busy).select(
        *PERIOD_KEY,
        "visit_seq",
        "visit_start_date",
        "visit_end_date",
        "visit_concept_id",
        "date_of_birth",
        known.alias("known_person"),
        F.coalesce((F.col("_events") > large_visit_events) | (F.col("_odd") > 0), F.lit(False)).alias("large"),
        F.when(known, F.coalesce("_events", F.lit(0)) + 2).otherwise(F.lit(0)).alias("_tokens"),
        F.when(known, F.coalesce("_concepts", F.lit(0)) + 2).otherwise(F.lit(0)).alias("_filled"),
        *label,
    )
    if busy is not None and stage is not None:
        # Read three times below.
        counted = stage(counted, "counted_visits" if labels is None else "counted_labelled_visits")
    blocks = _block_facts(visit_block(counted, busy), busy)
    order = Window.partitionBy(*PERIOD_KEY, "_block").orderBy("visit_seq")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    number = F.row_number().over(order)
    rank = (F.coalesce("_n0", F.lit(0)) + number).cast("bigint")
    tokens_before = F.coalesce("_t0", F.lit(0)) + F.coalesce(F.sum("_tokens").over(earlier), F.lit(0))
    intervals = F.col("num_of_visits") - 1
    result = blocks.select(
        "*",
        rank.alias("visit_rank"),
        F.when(number > 1, F.lag("visit_end_date").over(order)).otherwise(F.col("_end0")).alias("previous_end"),
        # Every earlier visit has an interval before it, except the period's first.
        (tokens_before + F.greatest(rank - 2, F.lit(0))).alias("first_position"),
        (F.col("_filled") - 2).alias("concepts"),
        (F.col("_all_filled") + intervals).alias("sequence_length"),
        (
            F.col("_all_tokens") + intervals - F.col("_final._tokens") - F.when(intervals > 0, 1).otherwise(0)
        ).alias("last_visit_start"),
    )
    kept = [
        *PERIOD_KEY,
        "visit_seq",
        "visit_rank",
        "visit_start_date",
        "visit_end_date",
        "previous_end",
        "visit_concept_id",
        "date_of_birth",
        "known_person",
        "first_position",
        "sequence_length",
        "num_of_visits",
        "last_visit_start",
        "large",
        "concepts",
    ]
    if labels is None:
        return result.select(*kept)
    return _repeat_for_labels(result).select(*kept, "label")


def _event_counts():
    """Of a visit's events: all, those with a concept, and those whose concept does not sort between
    the visit's start and end tokens."""
    concept = F.col("concept_id")
    odd = (concept <= SORT_VISIT_START) | (concept == SORT_VISIT_END)
    return [F.count("*").alias("_events"), F.count(concept).alias("_concepts"), F.count_if(odd).alias("_odd")]


def _joined_with_counts(visits: DataFrame, events: DataFrame) -> DataFrame:
    keyed = events.select(F.col("visit_person_id").alias("person_id"), "visit_seq", "concept_id")
    return visits.join(keyed.groupBy("person_id", "visit_seq").agg(*_event_counts()), ["person_id", "visit_seq"], "left")


def _with_counts(visits: DataFrame, events: DataFrame) -> DataFrame:
    """Visits with the numbers of their events, cut by person.

    Visits and events meet by person, so that the periods, which meet them by person too, and all
    windows of a period move no visit again. A visit key is once per person.
    """
    names = ["visit_start_date", "visit_end_date", "visit_concept_id"]
    rows = visits.select("person_id", "visit_seq", *names, F.lit(None).cast("bigint").alias("concept_id"), F.lit(1).alias("_is_visit"))
    of_visit = [F.lit(None).cast(rows.schema[name].dataType).alias(name) for name in names]
    keyed = events.select(F.col("visit_person_id").alias("person_id"), "visit_seq", *of_visit, "concept_id", F.lit(0).alias("_is_visit"))
    met = rows.unionByName(keyed.where("person_id IS NOT NULL AND visit_seq IS NOT NULL")).repartition("person_id")
    met = cut(met, known_rows(visits, events), "person_id")
    # Each column by itself: the largest of structs cannot be found by hashing and would sort all rows.
    visit = [F.max(name).alias(name) for name in [*names, "_is_visit"]]
    counted = met.groupBy("person_id", "visit_seq").agg(*visit, *_event_counts())
    # The visit's own row is no event.
    return counted.where("_is_visit = 1").select(
        "person_id", "visit_seq", *names, (F.col("_events") - 1).alias("_events"), "_concepts", "_odd"
    )


def _person_labels(labels: DataFrame) -> DataFrame:
    """One row per labelled person, with the number of labels."""
    return labels.groupBy("person_id").agg(F.bool_or("label").alias("label"), F.count("*").alias("_copies"))


def _repeat_for_labels(visits: DataFrame) -> DataFrame:
    """A person labelled twice gets every token twice, as a join of tokens and labels would give."""
    copies = F.col("_copies")
    return (
        visits.withColumn("large", F.col("large") | (copies > 1))
        .withColumn("first_position", F.col("first_position") * copies)
        .withColumn("sequence_length", F.col("sequence_length") * copies)
        .withColumn("last_visit_start", F.col("last_visit_start") * copies)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    )


def _block_facts(visits: DataFrame, busy: DataFrame | None) -> DataFrame:
    """What a visit must know about its period: the totals, and the sums of earlier blocks."""
    last = F.struct("visit_seq", "visit_end_date", "_tokens")
    facts = {
        "num_of_visits": F.count("*"),
        "_all_tokens": F.sum("_tokens"),
        "_all_filled": F.sum("_filled"),
        "_final": F.max(last),
    }
    block = Window.partitionBy(*PERIOD_KEY, "_block")
    whole = visits.select("*", *[fact.over(block).alias(name) for name, fact in facts.items()])
    if busy is None:
        nothing = {"_n0": "bigint", "_t0": "bigint", "_end0": "date"}
        return whole.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()])
    months = visits.where("_block <> 0").groupBy(*PERIOD_KEY, "_block").agg(
        *[fact.alias(name) for name, fact in facts.items()]
    )
    period = months.groupBy(*PERIOD_KEY).agg(
        F.sum("num_of_visits").alias("_p_num_of_visits"),
        F.sum("_all_tokens").alias("_p_all_tokens"),
        F.sum("_all_filled").alias("_p_all_filled"),
        F.max("_final").alias("_p_final"),
    )
    before = blocks_before(
        months,
        PERIOD_KEY,
        "_block",
        _n0=F.sum("num_of_visits"),
        _t0=F.sum("_all_tokens"),
        _final0=F.max("_final"),
    ).withColumn("_end0", F.col("_final0.visit_end_date"))
    joined = whole.join(before.join(period, PERIOD_KEY), [*PERIOD_KEY, "_block"], "left")
    return joined.select(
        *visits.columns,
        F.coalesce("_p_num_of_visits", "num_of_visits").alias("num_of_visits"),
        F.coalesce("_p_all_tokens", "_all_tokens").alias("_all_tokens"),
        F.coalesce("_p_all_filled", "_all_filled").alias("_all_filled"),
        F.coalesce("_p_final", "_final").alias("_final"),
        "_n0",
        "_t0",
        "_end0",
    )


def _carried(visits: DataFrame) -> list[str]:
    """Visit columns that every token takes along."""
    extra = ["label"] if "label" in visits.columns else []
    return [*PERIOD_KEY, "first_position", "sequence_length", "num_of_visits", "last_visit_start", "large", *extra]


def _token(concept, date, sort_order, birth, marker=None):
    """A token inside a visit as a struct."""
    return F.struct(
        concept.alias("concept_ids"),
        (F.col("visit_rank") % 2 + 1).alias("visit_segments"),
        week_index(date).alias("dates"),
        age_in_months(birth, date).alias("ages"),
        F.col("visit_rank").alias("visit_concept_orders"),
        F.col("visit_concept_id").cast("string").alias("visit_concept_ids"),
        sort_order.cast("bigint").alias("sort_order"),
        date.alias("token_date"),
    )


def _interval():
    days = F.datediff("visit_start_date", "previous_end")
    zero = F.lit(0).cast("bigint")
    return F.struct(
        interval_token(days).alias("concept_ids"),
        zero.alias("visit_segments"),
        zero.alias("dates"),
        F.lit(-1).cast("bigint").alias("ages"),
        F.col("visit_rank").alias("visit_concept_orders"),
        F.lit("0").alias("visit_concept_ids"),
        F.lit(SORT_INTERVAL).cast("bigint").alias("sort_order"),
        F.col("visit_start_date").alias("token_date"),
    )


def interval_tokens(ranked: DataFrame) -> DataFrame:
    """One token per visit that has a predecessor, also for persons without a person record."""
    return ranked.where(F.col("visit_rank") > 1).select(*_carried(ranked), _interval().alias("_t")).select(
        *_carried(ranked), "_t.*"
    )


def visit_tokens(ranked: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Start and end tokens of the visits of known persons, with columns of the visit to take along."""
    birth = F.col("date_of_birth")
    ends = F.array(
        _token(F.lit(VISIT_START), F.col("visit_start_date"), F.lit(SORT_VISIT_START), birth),
        _token(F.lit(VISIT_END), F.col("visit_end_date"), F.lit(SORT_VISIT_END), birth),
    )
    return (
        ranked.where("known_person")
        .select(*_carried(ranked), *also, F.explode(ends).alias("_t"))
        .select(*_carried(ranked), *also, "_t.*")
    )


def event_tokens(events: DataFrame, ranked: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Events inside a ranked visit. Person and age are the visit's, the date is the event's."""
    inside = events.select(F.col("visit_person_id").alias("person_id"), "visit_seq", "concept_id", "start_date").join(
        ranked.where("known_person"), ["person_id", "visit_seq"]
    )
    concept = F.col("concept_id")
    token = _token(concept.cast("string"), F.col("start_date"), concept, F.col("date_of_birth"))
    return inside.select(*_carried(ranked), *also, token.alias("_t")).select(*_carried(ranked), *also, "_t.*")


def _all_tokens(events: DataFrame, ranked: DataFrame) -> DataFrame:
    return (
        interval_tokens(ranked).unionByName(visit_tokens(ranked)).unionByName(event_tokens(events, ranked))
    )


def token_stream(events: DataFrame, ranked: DataFrame) -> DataFrame:
    """All tokens with their 0-based position in the sequence.

    A token's position is where its visit begins plus its rank within the visit, so a period of
    any length is ordered visit by visit. ``ranked`` should be a staged table. What begins and ends a
    visit has its place from counts, and events are ranked where they met their visit: no token is
    moved. Visits marked large (very many events, a concept that sorts outside of the visit's
    start and end, or a person labelled more than once) are ranked with all their tokens. The size at
    which a visit is large changes the plan and never the positions.
    """
    label = ["label"] if "label" in ranked.columns else []
    names = [*TOKEN_COLUMNS, *label]
    large_visits = ranked.where("large")
    if large_visits.isEmpty():
        return _ordinary_stream(events, ranked).select(*names)
    apart = large_visits.select(F.col("person_id").alias("visit_person_id"), "visit_seq").distinct()
    others = like_measured(events.join(apart, ["visit_person_id", "visit_seq"], "left_anti"), events)
    ordinary = _ordinary_stream(others, ranked.where(~F.col("large"))).select(*names)
    return ordinary.unionByName(_large_stream(events, large_visits).select(*names))


def _ordinary_stream(events: DataFrame, ranked: DataFrame) -> DataFrame:
    """Tokens of visits whose events sort between the start and end tokens, null concepts after both."""
    begun = F.col("first_position") + F.when(F.col("visit_rank") > 1, 1).otherwise(0)
    ended = begun + 1 + F.col("concepts")
    at = F.when(F.col("sort_order") == SORT_VISIT_START, begun).otherwise(ended)
    intervals = interval_tokens(ranked).withColumn("orders", F.col("first_position"))
    ends = visit_tokens(ranked, ["visit_rank", "concepts"]).withColumn("orders", at).drop("visit_rank", "concepts")
    visit = Window.partitionBy("person_id", "visit_seq", "observation_period_id", "visit_rank")
    rank = F.row_number().over(visit.orderBy(F.col("sort_order").asc_nulls_last(), "token_date"))
    after_end = F.when(F.col("sort_order").isNull(), 1).otherwise(0)
    events = cut(events, known_rows(events), "visit_person_id", "visit_seq")
    inside = event_tokens(events, ranked, ["visit_seq", "visit_rank"]).withColumn("orders", begun + rank + after_end)
    parts = [f.withColumn("orders", F.col("orders").cast("bigint")) for f in (intervals, ends, inside.drop("visit_seq", "visit_rank"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _large_stream(events: DataFrame, ranked: DataFrame) -> DataFrame:
    """Visits of any size, cut along the order of their tokens (null concepts last, then concept, then
    day); what comes before each cut is counted first."""
    visit = [*PERIOD_KEY, "visit_concept_orders"]
    # Never null, and in the order of the window below.
    cuts = {
        "_null_cut": F.col("sort_order").isNull().cast("int"),
        "_concept_cut": F.coalesce("sort_order", F.lit(0)),
        "_day_cut": F.coalesce(F.datediff("token_date", F.lit("1970-01-01").cast("date")), F.lit(-(2**31))),
    }
    tokens = _all_tokens(events, ranked).withColumns(cuts)
    sizes = tokens.groupBy(*visit, *cuts).agg(F.count("*").alias("_rows"))
    tokens = tokens.join(blocks_before(sizes, visit, list(cuts), _before=F.sum("_rows")), [*visit, *cuts], "left")
    within = Window.partitionBy(*visit, *cuts).orderBy(F.col("sort_order").asc_nulls_last(), "token_date")
    position = F.col("first_position") + F.coalesce("_before", F.lit(0)) + F.row_number().over(within) - 1
    return tokens.withColumn("orders", position.cast("bigint"))


def create_tokens(
    tables: dict[str, DataFrame],
    events: DataFrame,
    visits: DataFrame,
    labels: DataFrame | None = None,
    busy: DataFrame | None = None,
    stage: Staging | None = None,
    large_visit_events: int = LARGE_VISIT_EVENTS,
) -> DataFrame:
    """The token stream of a whole data set from linked events and keyed visits."""
    stage = stage or Staging(events.sparkSession)
    ranked = rank_visits(
        visits, tables["observation_period"], tables["person"], events, labels, busy, large_visit_events, stage, meet_by_person=True
    )
    return token_stream(events, stage(ranked, "ranked_visits"))
