"""A linear baseline on which tokens are present at all."""

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ehrseq.operators.sizes import join_lookup
from ehrseq.schema import PERIOD_KEY
from ehrseq.staging import Staging, like_measured, measured

# The token id of the bias among weights.
BIAS = -1


def token_presence(examples: DataFrame) -> DataFrame:
    """The distinct token ids of each example, prefix and padding included."""
    return examples.withColumn("present", F.sort_array(F.array_distinct("token_ids"))).drop("token_ids")


def presence_rows(examples: DataFrame, keys: list[str] = PERIOD_KEY) -> DataFrame:
    """Long form: one row per example and present token."""
    return token_presence(examples).select(*keys, F.explode("present").alias("token_id"))


def baseline_scores(examples: DataFrame, weights: DataFrame, bias: float, keys: list[str] = PERIOD_KEY) -> DataFrame:
    """Probability from the weights of the present tokens."""
    weighted = join_lookup(presence_rows(examples, keys), weights, "token_id", "left")
    logit = F.sum(F.coalesce("weight", F.lit(0.0))) + F.lit(bias)
    return weighted.groupBy(*keys).agg((1 / (1 + F.exp(-logit))).alias("prediction"))


def fit_baseline(examples: DataFrame, vocabulary_size: int, max_iter: int = 20, reg: float = 0.01, stage: Staging | None = None):
    """Logistic regression on the presence vectors. Needs ``token_ids`` and ``finetune_label``."""
    return LogisticRegression(
        featuresCol="features", labelCol="finetune_label", maxIter=max_iter, regParam=reg
    ).fit(presence_vectors(examples, vocabulary_size, stage))


def model_weights(model, spark: SparkSession) -> DataFrame:
    """The fitted weights as a table for ``baseline_scores``; as long as the vocabulary, like the model."""
    weights = model.coefficients.toArray()
    return spark.createDataFrame(pa.table({"token_id": np.arange(len(weights)), "weight": weights}))


def presence_vectors(examples: DataFrame, vocabulary_size: int, stage: Staging | None = None) -> DataFrame:
    """Sparse 0/1 vectors over the vocabulary, for Spark's own classifiers, as a staged table.

    A sparse vector is stored as its size and its sorted places, which the tasks have in the token
    ids already; read back, the column is a vector. Ids past the vocabulary are left out.
    """
    stage = stage or Staging(examples.sparkSession)
    known = F.filter("token_ids", lambda i: (i >= 0) & (i < vocabulary_size))
    places = F.sort_array(F.array_distinct(known)).cast("array<int>")
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(vocabulary_size).alias("size"),
        places.alias("indices"),
        F.transform(places, lambda _: F.lit(1.0)).alias("values"),
    )
    rows = examples.withColumn("features", vector).withColumn("finetune_label", F.col("finetune_label").cast("double"))
    vectors = StructType([StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in rows.schema])
    return stage(rows, f"presence_vectors_{uuid.uuid4().hex}", vectors)


class AdamSettings(NamedTuple):
    """Steps and rates of ``fit_by_gradient``."""

    steps: int = 100
    learning_rate: float = 0.01
    weight_decay: float = 0.0
    first_decay: float = 0.9
    second_decay: float = 0.999
    epsilon: float = 1e-8


def fit_by_gradient(
    examples: DataFrame, vocabulary: DataFrame, settings: AdamSettings = AdamSettings(), keys: list[str] = PERIOD_KEY, stage: Staging | None = None
) -> DataFrame:
    """(token_id, weight) of the linear label model by full-batch Adam on the mean binary cross-entropy.

    The definition's own optimiser, from zero weights: each step joins the weights to the present
    tokens, sums them per example, and sums the gradient per token, all over the cluster. The bias is
    the weight of ``BIAS``, which every example has. Weights of each step are a staged table with
    the moments beside them. Examples without a label are left out; without any example all weights
    stay zero.
    """
    stage = stage or Staging(examples.sparkSession)
    name = uuid.uuid4().hex
    given = examples.where("finetune_label IS NOT NULL").select(*keys, "token_ids", F.col("finetune_label").cast("double").alias("label"))
    tokens = F.explode(F.array_append(F.array_distinct(F.col("token_ids").cast("array<bigint>")), F.lit(BIAS).cast("bigint")))
    rows = given.select(*keys, "label", tokens.alias("token_id"))
    rows = stage.measured(rows, f"presence_{name}", {"examples": F.count_if(F.col("token_id") == BIAS)})
    count = float(max(measured(rows).values["examples"], 1))
    zero = [F.lit(0.0).alias(c) for c in ("weight", "first", "second")]
    bias = examples.sparkSession.range(1).select(F.lit(BIAS).cast("bigint").alias("token_id"), *zero)
    weights = stage.measured(vocabulary.select(F.col("token_id").cast("bigint"), *zero).unionByName(bias), f"weights_{name}_0")
    one, two = settings.first_decay, settings.second_decay
    for n in range(1, settings.steps + 1):
        joined = join_lookup(rows, like_measured(weights.select("token_id", "weight"), weights), "token_id", "left")
        margin = F.sum(F.coalesce("weight", F.lit(0.0))).over(Window.partitionBy(*keys))
        residual = (1 / (1 + F.exp(-margin)) - F.col("label")) / count
        gradients = joined.select("token_id", residual.alias("_residual")).groupBy("token_id").agg(F.sum("_residual").alias("_gradient"))
        slope = F.coalesce("_gradient", F.lit(0.0)) + settings.weight_decay * F.col("weight")
        first, second = one * F.col("first") + (1 - one) * slope, two * F.col("second") + (1 - two) * slope * slope
        moved = F.col("weight") - settings.learning_rate / (1 - one**n) * F.col("first") / (F.sqrt("second") / (1 - two**n) ** 0.5 + settings.epsilon)
        stepped = weights.join(gradients, "token_id", "left").select("token_id", "weight", first.alias("first"), second.alias("second"))
        weights = stage.measured(stepped.withColumn("weight", moved), f"weights_{name}_{n}")
    return like_measured(weights.select("token_id", "weight"), weights)
