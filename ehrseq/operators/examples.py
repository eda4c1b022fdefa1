"""Training examples: truncated, encoded, masked, padded and labelled.

Everything starts from the long token stream. Truncation is a filter on positions that each
token can check alone, so at most ``max_length`` tokens of a period are ever brought together.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ehrseq.functions.arrays import prefix_and_pad, relative_orders
from ehrseq.functions.draws import uniform, whole_number
from ehrseq.operators.numbering import number_rows
from ehrseq.operators.vocabulary import encode
from ehrseq.schema import CLS_ID, FIRST_TOKEN_ID, MASK_ID, PAD_ID, PERIOD_KEY
from ehrseq.settings import ExampleSettings

# How often a position is masked, and what becomes of a masked position.
MASK_CONCEPT_RATE = 0.15
MASK_VISIT_RATE = 0.5
BECOMES_MASK_BELOW = 0.8
BECOMES_RANDOM_BELOW = 0.9

# Draws are numbered in this many blocks; orders work only.
DRAW_BLOCKS = 4096


def bounds(settings: ExampleSettings) -> tuple[Column, Column]:
    """First position kept and first position no longer kept, from facts every token carries."""
    room = settings.max_length - 1
    n = F.col("sequence_length")
    if settings.next_visit:
        # The end is the last token before the final visit; that token itself is not kept.
        end = F.col("last_visit_start") - 1
        return F.greatest(F.lit(0), end - room), end
    last = n - (1 if settings.next_token else 0)
    tail = F.greatest(F.lit(0), last - room)
    if settings.truncate == "tail":
        return tail, last
    drawn = whole_number(F.lit(0), last - room, uniform(settings.seed, "truncate", *PERIOD_KEY))
    start = F.when(n > room, drawn).otherwise(tail)
    return start, F.when(n > room, F.least(last, start + room)).otherwise(last)


def truncate(tokens: DataFrame, settings: ExampleSettings) -> DataFrame:
    """Tokens an example needs, with their bounds. A next-token target needs one token more.

    For a next-visit target, sequences with a single visit have nothing to predict and drop out.
    """
    start, end = bounds(settings)
    framed = tokens.withColumn("begin", start).withColumn("end", end)
    if settings.next_visit:
        framed = framed.where("last_visit_start > 0")
    beyond = F.col("end") + (1 if settings.next_token else 0)
    return framed.where((F.col("orders") >= F.col("begin")) & (F.col("orders") < beyond))


def masked_concepts(tokens: DataFrame, vocabulary: DataFrame, settings: ExampleSettings) -> DataFrame:
    """Choose positions to predict and what to show there instead.

    Adds ``masked_token_mask`` (false where the token must be predicted) and
    ``masked_token_ids``. With one mask per visit, a visit's first chosen position wins.
    """
    position = [*PERIOD_KEY, "orders"]
    chosen = uniform(settings.seed, "mask", *position) < MASK_CONCEPT_RATE
    if settings.one_mask_per_visit:
        visit = Window.partitionBy(*PERIOD_KEY, "visit_concept_orders")
        tokens = tokens.withColumn("_chosen", chosen).withColumn(
            "_first", F.min(F.when(F.col("_chosen"), F.col("orders"))).over(visit)
        )
        chosen = F.coalesce(F.col("orders") == F.col("_first"), F.lit(False))
    last_id = vocabulary.agg(F.max("token_id")).scalar()
    dice = uniform(settings.seed, "dice", *position)
    other = whole_number(F.lit(FIRST_TOKEN_ID), last_id, uniform(settings.seed, "word", *position))
    shown = (
        F.when(dice < BECOMES_MASK_BELOW, F.lit(MASK_ID))
        .when(dice < BECOMES_RANDOM_BELOW, other)
        .otherwise(F.col("token_id"))
    )
    return (
        tokens.withColumn("masked_token_mask", ~chosen)
        .withColumn("masked_token_ids", F.when(F.col("masked_token_mask"), F.col("token_id")).otherwise(shown))
        .drop("_chosen", "_first")
    )


def masked_visits(tokens: DataFrame, settings: ExampleSettings) -> DataFrame:
    """Hide the visit concept of half the positions."""
    chosen = uniform(settings.seed, "mask visit", *PERIOD_KEY, "orders") < MASK_VISIT_RATE
    return tokens.withColumn("masked_visit_token_mask", ~chosen).withColumn(
        "masked_visit_token_ids", F.when(chosen, F.lit(MASK_ID)).otherwise(F.col("visit_token_id")).cast("bigint")
    )


def next_visit_targets(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The set of token ids in the final visit of each sequence, as a sorted array."""
    final = tokens.where("last_visit_start > 0").where(F.col("orders") >= F.col("last_visit_start"))
    encoded = encode(final, "concept_ids", vocabulary, "token_id")
    return encoded.groupBy(*PERIOD_KEY).agg(F.sort_array(F.collect_set("token_id")).alias("next_visit_token_set"))


def dense_targets(ids: Column, vocabulary: DataFrame) -> Column:
    """A 0/1 array over the vocabulary from a sorted set of ids: zeros up to each id, then a one.

    As wide as the vocabulary; the set itself is the usual form.
    """
    last_id = vocabulary.agg(F.max("token_id")).scalar()

    def zeros(count):
        return F.array_repeat(F.lit(0.0), count.cast("int"))

    def up_to(token_id, i):
        previous = F.when(i == 0, F.lit(-1)).otherwise(F.get(ids, i - 1))
        return F.concat(zeros(token_id - previous - 1), F.array(F.lit(1.0)))

    ones = F.flatten(F.transform(ids, up_to))
    return F.concat(ones, zeros(last_id - F.element_at(ids, -1))).cast("array<float>")


def collect_examples(encoded: DataFrame, settings: ExampleSettings) -> DataFrame:
    """Bring the kept tokens of each period together and lay out the fixed-length arrays."""
    names = ["token_id", "visit_token_id", "visit_segments", "visit_concept_orders", "ages", "dates"]
    names += ["masked_token_ids", "masked_token_mask", "masked_visit_token_ids", "masked_visit_token_mask"]
    names = [n for n in names if n in encoded.columns]
    facts = [F.first("begin").alias("begin"), F.first("end").alias("end")]
    if settings.label:
        facts.append(F.first("label").cast("float").alias("finetune_label"))
    rows = encoded.groupBy(*PERIOD_KEY).agg(
        F.sort_array(F.collect_list(F.struct("orders", *names))).alias("_all"), *facts
    )
    # The extra token a next-token target needs is not an input.
    kept = F.when(F.col("end") > F.col("begin"), F.slice("_all", F.lit(1), (F.col("end") - F.col("begin")).cast("int")))
    rows = rows.withColumn("_in", F.coalesce(kept, F.slice("_all", 1, 0)))
    size = settings.max_length

    def laid_out(values, prefix, padding, name, kind="bigint"):
        array = prefix_and_pad(values.cast(f"array<{kind}>"), F.lit(prefix).cast(kind), F.lit(padding).cast(kind), size)
        return array.alias(name)

    columns = []
    if settings.token_ids:
        columns.append(laid_out(F.col("_in.token_id"), CLS_ID, PAD_ID, "token_ids"))
    if settings.visit_token_ids:
        columns.append(laid_out(F.col("_in.visit_token_id"), CLS_ID, PAD_ID, "visit_token_ids"))
    if settings.segments:
        columns.append(laid_out(F.col("_in.visit_segments"), 0, 0, "visit_segments"))
    if settings.visit_orders:
        relative = relative_orders(F.col("_in.visit_concept_orders"))
        columns.append(laid_out(relative, 0, size - 1, "visit_concept_orders"))
    if settings.ages:
        columns.append(laid_out(F.col("_in.ages"), 0, 0, "ages", "float"))
    if settings.dates:
        columns.append(laid_out(F.col("_in.dates"), 0, 0, "dates", "float"))
    real = F.transform("_in", lambda _: F.lit(0.0))
    columns.append(laid_out(real, 0.0, float("-inf"), "padding_mask", "float"))
    if settings.mask_concepts:
        columns.append(laid_out(F.col("_in.masked_token_ids"), CLS_ID, PAD_ID, "masked_token_ids"))
        columns.append(laid_out(F.col("_in.masked_token_mask"), True, True, "masked_token_mask", "boolean"))
    if settings.mask_visits:
        columns.append(laid_out(F.col("_in.masked_visit_token_ids"), CLS_ID, PAD_ID, "masked_visit_token_ids"))
        columns.append(
            laid_out(F.col("_in.masked_visit_token_mask"), True, True, "masked_visit_token_mask", "boolean")
        )
    if settings.next_token:
        shifted = F.slice("_all", 2, size - 1)
        columns.append(laid_out(shifted["token_id"], CLS_ID, PAD_ID, "next_token_ids"))
    if settings.label:
        columns.append(F.col("finetune_label"))
    return rows.select(*PERIOD_KEY, *columns)


def build_examples(
    tokens: DataFrame, vocabulary: DataFrame, visit_vocabulary: DataFrame, settings: ExampleSettings
) -> DataFrame:
    """One row of model inputs and targets per observation period.

    One shuffle of the kept tokens: masking windows and the final grouping share it.
    """
    kept = encode(truncate(tokens, settings), "concept_ids", vocabulary, "token_id")
    if settings.visit_token_ids or settings.mask_visits:
        kept = encode(kept, "visit_concept_ids", visit_vocabulary, "visit_token_id")
    # Gathering tokens within a split before they meet would sort all of the split.
    kept = kept.repartition(*PERIOD_KEY)
    if settings.mask_concepts:
        kept = masked_concepts(kept, vocabulary, settings)
    if settings.mask_visits:
        kept = masked_visits(kept, settings)
    examples = collect_examples(kept, settings)
    if settings.next_visit:
        examples = examples.join(next_visit_targets(tokens, vocabulary), PERIOD_KEY)
        if settings.dense_next_visit:
            dense = dense_targets(F.col("next_visit_token_set"), vocabulary)
            examples = examples.withColumn("next_visit_token_set", dense)
    return examples


def cap_training_set(examples: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """A reproducible choice of at most ``rows`` examples, for learning curves.

    Smaller caps choose a subset of what larger caps choose. Examples are numbered in the order
    of their draws, block by block, so no task sees them all.
    """
    drawn = examples.withColumn("_draw", uniform(seed, "cap", *PERIOD_KEY)).withColumn("_all", F.lit(0))
    blocks = drawn.withColumn("_block", F.floor(F.col("_draw") * DRAW_BLOCKS))
    numbered = number_rows(blocks, "_number", ["_all"], "_block", ["_draw", *PERIOD_KEY])
    return numbered.where(F.col("_number") <= rows).select(*examples.columns)
