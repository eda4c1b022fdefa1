"""Prediction metrics as aggregates over prediction tables.

A prediction table has any number of key columns that name the experiment cell; all cells are
evaluated in one job.
"""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ehrseq.functions.losses import (
    argmax,
    binary_cross_entropy,
    multi_label_hits,
    multi_label_loss,
    softmax_cross_entropy,
)


def _score_block(score: Column) -> Column:
    """An order-preserving block number that spreads scores near 0 and 1 as well as those between."""
    inner = F.floor(F.log(score / (1 - score)) * 1024)
    outer = F.floor(score * 4096)
    return F.when(score <= 0, outer - 10**6).when(score >= 1, outer + 10**6).otherwise(inner)


def _points(predictions: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score. Equal scores collapse before the shuffle."""
    positive = F.col(label).cast("int")
    return predictions.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(
        F.sum(positive).alias("_pos"), F.sum(1 - positive).alias("_neg")
    )


def _by_score(points: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives per distinct score, how many of each score lower, and in all.

    Running counts go block by block, so one cell may hold any share of the predictions.
    """
    points = points.withColumn("_block", _score_block(F.col("_score")))
    sums = points.groupBy(*keys, "_block").agg(F.sum("_pos").alias("_bp"), F.sum("_neg").alias("_bn"))
    cell = Window.partitionBy(*keys)
    earlier = cell.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select(
        *keys,
        "_block",
        F.sum("_bp").over(earlier).alias("_pos0"),
        F.sum("_bn").over(earlier).alias("_neg0"),
        F.sum("_bp").over(cell).alias("_p"),
        F.sum("_bn").over(cell).alias("_n"),
    )
    lower = Window.partitionBy(*keys, "_block").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0)
    return points.join(blocks, [*keys, "_block"]).select(
        *keys,
        "_pos",
        "_neg",
        "_p",
        "_n",
        (F.coalesce("_pos0", nothing) + F.coalesce(F.sum("_pos").over(lower), nothing)).alias("_pos_below"),
        (F.coalesce("_neg0", nothing) + F.coalesce(F.sum("_neg").over(lower), nothing)).alias("_neg_below"),
    )


def score_counts(predictions: DataFrame, keys: list[str], score: str = "prediction", label: str = "label") -> DataFrame:
    """(cell, score, positives, negatives): all that the label metrics need to know of predictions.

    Counts of several runs add up (``merge_counts``), so a grown prediction table needs no rescan.
    """
    return _points(predictions, keys, score, label).select(
        *keys, F.col("_score").alias("score"), F.col("_pos").alias("positives"), F.col("_neg").alias("negatives")
    )


def merge_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of several runs, one under the other, as the counts of all their predictions."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("positives", "negatives")]
    return counts.groupBy(*keys, "score").agg(*sums)


def ranking_metrics(predictions: DataFrame, keys: list[str], score: str = "prediction", label: str = "label") -> DataFrame:
    """Area under the ROC curve and average precision per cell; null where a class is missing.

    AUC counts the pairs a positive wins against a negative, ties as half. Average precision sums
    the precision at each distinct score, weighted by the positives found there.
    """
    return _ranking(_points(predictions, keys, score, label), keys)


def _ranking(points: DataFrame, keys: list[str]) -> DataFrame:
    found = (F.col("_p") - F.col("_pos_below")).cast("double")
    called = found + (F.col("_n") - F.col("_neg_below"))
    half_pairs = F.col("_pos").cast("double") * (2 * F.col("_neg_below") + F.col("_neg"))
    sums = _by_score(points, keys).groupBy(*keys).agg(
        F.sum(half_pairs).alias("_half_pairs"),
        F.sum(F.when(F.col("_p") > 0, F.col("_pos") / F.col("_p") * found / called)).alias("auprc"),
        (F.first("_p").cast("double") * F.first("_n")).alias("_pairs"),
    )
    auc = F.when(F.col("_pairs") > 0, F.col("_half_pairs") / 2 / F.col("_pairs"))
    return sums.select(*keys, auc.alias("auc"), "auprc")


def roc_auc(predictions: DataFrame, keys: list[str], score: str = "prediction", label: str = "label") -> DataFrame:
    return ranking_metrics(predictions, keys, score, label).select(*keys, "auc")


def average_precision(predictions, keys, score: str = "prediction", label: str = "label") -> DataFrame:
    return ranking_metrics(predictions, keys, score, label).select(*keys, "auprc")


def brier_score(score: str = "prediction", label: str = "label") -> Column:
    y = F.col(label).cast("double")
    return F.avg((F.col(score) - y) * (F.col(score) - y))


def mean_binary_cross_entropy(score: str = "prediction", label: str = "label") -> Column:
    return F.avg(binary_cross_entropy(F.col(score).cast("double"), F.col(label).cast("double")))


def label_metrics(
    predictions: DataFrame, keys: list[str], score: str = "prediction", label: str = "label", stage=None
) -> DataFrame:
    """Loss, AUC, average precision and Brier score per cell, one column each.

    All four come from the counts per distinct score. Pass ``stage`` (a ``Staging``) to have those
    computed once, in one pass over the predictions.
    """
    counts = score_counts(predictions, keys, score, label)
    if stage is not None:
        counts = stage(counts, f"score_counts_{uuid.uuid4().hex}")
    return metrics_of_counts(counts, keys)


def metrics_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``label_metrics`` from merged counts, which should be a table."""
    points = counts.select(
        *keys, F.col("score").alias("_score"), F.col("positives").alias("_pos"), F.col("negatives").alias("_neg")
    )
    s, pos, neg = F.col("_score"), F.col("_pos"), F.col("_neg")
    one, zero = F.lit(1.0), F.lit(0.0)
    rows = F.sum(F.when(s.isNotNull(), pos + neg))
    means = points.groupBy(*keys).agg(
        (F.sum(pos * binary_cross_entropy(s, one) + neg * binary_cross_entropy(s, zero)) / rows).alias("mean_loss"),
        (F.sum(pos * (s - 1) * (s - 1) + neg * s * s) / rows).alias("brier"),
    )
    return means.join(_ranking(points, keys), keys).select(*keys, "mean_loss", "auc", "auprc", "brier")


def token_metrics(
    predictions: DataFrame,
    keys: list[str],
    logits: str = "logits",
    target: str = "target",
    ignored: Column | None = None,
) -> DataFrame:
    """Mean cross entropy and accuracy of token predictions, without ignored positions.

    Masked objectives ignore the positions that were not masked. A next-token objective counts
    every position, padding included, unless ``ignored`` says otherwise.
    """
    scores, truth = F.col(logits).cast("array<double>"), F.col(target)
    counted = predictions if ignored is None else predictions.where(~ignored)
    return counted.groupBy(*keys).agg(
        F.avg(softmax_cross_entropy(scores, truth)).alias("mean_loss"),
        F.avg((argmax(scores) == truth).cast("double")).alias("mean_accuracy"),
    )


def multi_label_metrics(
    predictions: DataFrame, keys: list[str], logits: str = "logits", targets: str = "targets"
) -> DataFrame:
    """Mean loss and accuracy over all cells of 0/1 target arrays."""
    scores, truth = F.col(logits).cast("array<double>"), F.col(targets).cast("array<double>")
    cells = F.sum(F.size(scores))
    return predictions.groupBy(*keys).agg(
        (F.sum(multi_label_loss(scores, truth)) / cells).alias("mean_loss"),
        (F.sum(multi_label_hits(scores, truth)) / cells).alias("mean_accuracy"),
    )


def combined_loss(per_objective: list[DataFrame], keys: list[str]) -> DataFrame:
    """The plain sum of the objectives' mean losses per cell."""
    losses = [frame.select(*keys, F.col("mean_loss").alias("_loss")) for frame in per_objective]
    return reduce(DataFrame.unionByName, losses).groupBy(*keys).agg(F.sum("_loss").alias("combined_loss"))


# How metrics are named in reports.
METRIC_NAMES = {
    "mean_loss": "mean loss",
    "auc": "AUC",
    "auprc": "AUPRC",
    "brier": "Brier score",
    "mean_accuracy": "mean accuracy",
}


def metric_rows(metrics: DataFrame, keys: list[str], objective: str, is_train: bool | str) -> DataFrame:
    """One row per cell and metric, under the report's metric names.

    ``is_train`` names a boolean key column where training and validation rows stand side by side,
    of one or many epochs.
    """
    train = F.col(is_train) if isinstance(is_train, str) else F.lit(is_train)
    side = F.when(train, "train").otherwise("validation")
    present = [c for c in METRIC_NAMES if c in metrics.columns]
    named = [F.struct(F.concat_ws(" ", side, F.lit(objective), F.lit(METRIC_NAMES[c])).alias("metric"), F.col(c).alias("value")) for c in present]
    return metrics.select(*keys, F.explode(F.array(*named)).alias("_m")).select(*keys, "_m.*")


def metric_table(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per cell and one column per metric name."""
    return rows.groupBy(*keys).pivot("metric", names).agg(F.first("value"))
