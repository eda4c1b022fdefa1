"""Token dictionaries: fitting, encoding and decoding."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ehrseq.functions.draws import uniform
from ehrseq.operators.numbering import number_rows
from ehrseq.operators.sizes import join_lookup
from ehrseq.schema import FIRST_TOKEN_ID, OOV_ID, SPECIAL_TOKENS
from ehrseq.staging import like_measured

# Tokens are numbered by blocks of equal beginning, so numbering needs no single task. Orders work only.
BLOCK_CHARACTERS = 5


def in_training_split(fraction: float, seed: int = 0):
    """Whether a person belongs to the training side; no person is on both."""
    return uniform(seed, "split", "person_id") < fraction


def split_by_person(frame: DataFrame, fraction: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    train = in_training_split(fraction, seed)
    return frame.where(train), frame.where(~train)


def _special_tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SPECIAL_TOKENS)), "token_id bigint, token string").select(
        "token", "token_id"
    )


def fit_vocabulary(tokens: DataFrame, column: str) -> DataFrame:
    """Distinct tokens of a long-form column, numbered in token order after the special tokens.

    Pass the training split only. The same data always gives the same numbers. A token spelt like
    a special one is that one.
    """
    words = tokens.where(F.col(column).isNotNull() & ~F.col(column).isin(SPECIAL_TOKENS)).select(F.col(column).alias("token")).distinct()
    blocks = words.withColumn("_all", F.lit(0)).withColumn("_block", F.substring("token", 1, BLOCK_CHARACTERS))
    numbered = number_rows(blocks, "_number", ["_all"], "_block", ["token"])
    ids = numbered.select("token", (F.col("_number") + FIRST_TOKEN_ID - 1).alias("token_id"))
    return _special_tokens(tokens.sparkSession).unionByName(ids)


def encode(tokens: DataFrame, column: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """Add the id of each token; unknown tokens get the out-of-vocabulary id."""
    lookup = vocabulary.select(F.col("token").alias(column), F.col("token_id").alias("_id"))
    joined = join_lookup(tokens, like_measured(lookup, vocabulary), column, "left")
    return joined.withColumn(name, F.coalesce("_id", F.lit(OOV_ID))).drop("_id")


def decode(ids: DataFrame, column: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """Add the token of each id; unknown ids get null."""
    lookup = vocabulary.select(F.col("token_id").alias(column), F.col("token").alias(name))
    return join_lookup(ids, like_measured(lookup, vocabulary), column, "left")


def vocabulary_facts(vocabulary: DataFrame) -> DataFrame:
    """Size, special ids, and the first and last id of ordinary tokens."""
    special = [
        F.max(F.when(F.col("token") == token, F.col("token_id"))).alias(name)
        for token, name in zip(SPECIAL_TOKENS, ["padding_id", "mask_id", "out_of_vocabulary_id", "classification_id"])
    ]
    return vocabulary.agg(
        F.count("*").alias("vocabulary_size"),
        *special,
        F.lit(FIRST_TOKEN_ID).cast("bigint").alias("first_token_id"),
        (F.count("*") - 1).alias("last_token_id"),
    )


def list_vocabulary(tokens: DataFrame, column: str) -> DataFrame:
    """Distinct values of a long-form column, sorted."""
    return tokens.select(F.col(column).alias("token")).distinct().orderBy("token")
