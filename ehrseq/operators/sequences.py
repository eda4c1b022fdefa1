"""One row of parallel arrays per observation period, and back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrseq.schema import PERIOD_KEY, SEQUENCE_ARRAYS

# No row can hold a period of any length. Longer sequences continue on further rows, whose
# ``orders`` go on counting; no token is lost.
TOKENS_PER_ROW = 200_000

# What a row says of the whole sequence, whatever part of it the row holds.
TOTALS = ["num_of_concepts", "num_of_visits", "last_visit_start"]


def collect_sequences(tokens: DataFrame, tokens_per_row: int = TOKENS_PER_ROW) -> DataFrame:
    """Gather each period's tokens into arrays in sequence order.

    ``num_of_concepts`` (tokens that are not null), ``num_of_visits`` and ``last_visit_start`` are
    those of the whole sequence on each of its rows; ``part`` is 0 but for the continuation rows
    of a sequence longer than ``tokens_per_row``.
    """
    label = [F.bool_or("label").alias("label")] if "label" in tokens.columns else []
    token = F.struct("orders", *[c for c in SEQUENCE_ARRAYS if c != "orders"])
    part = F.floor(F.col("orders") / tokens_per_row).cast("bigint")
    # Tokens meet before they are gathered: gathering them first within a split would sort all of it.
    rows = tokens.withColumn("part", part).repartition(*PERIOD_KEY, "part").groupBy(*PERIOD_KEY, "part").agg(
        F.sort_array(F.collect_list(token)).alias("_tokens"),
        F.max("sequence_length").alias("num_of_concepts"),
        F.max("num_of_visits").alias("num_of_visits"),
        F.max("last_visit_start").alias("last_visit_start"),
        *label,
    )
    return rows.select(
        *PERIOD_KEY,
        *[F.col(f"_tokens.{name}").alias(name) for name in SEQUENCE_ARRAYS],
        *TOTALS,
        "part",
        *(["label"] if label else []),
    )


def explode_sequences(sequences: DataFrame, keys: list[str] = PERIOD_KEY) -> DataFrame:
    """The long form of sequence rows, whole or in parts, with their stored positions.

    Sequences from elsewhere, without ``last_visit_start``, must be whole.
    """
    label = ["label"] if "label" in sequences.columns else []
    if "last_visit_start" in sequences.columns:
        start = F.col("last_visit_start")
    else:
        start = F.array_position("visit_concept_orders", F.element_at("visit_concept_orders", -1)) - 1
    facts = [
        F.col("num_of_concepts").cast("bigint").alias("sequence_length"),
        F.col("num_of_visits").cast("bigint").alias("num_of_visits"),
        start.cast("bigint").alias("last_visit_start"),
    ]
    zipped = F.explode(F.arrays_zip(*SEQUENCE_ARRAYS)).alias("_token")
    exploded = sequences.select(*keys, *label, *facts, zipped).select(
        *keys, *label, "sequence_length", "num_of_visits", "last_visit_start", "_token.*"
    )
    return exploded.withColumn("orders", F.col("orders").cast("bigint"))
