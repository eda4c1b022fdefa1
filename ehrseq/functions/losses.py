"""Losses and hits of single predictions, to be averaged by the caller."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the log of a probability is clamped here, so a sure but wrong answer stays finite.
LOG_FLOOR = -100.0


def _clamped_log(p: Column) -> Column:
    # A probability of zero has no logarithm in SQL; it takes the floor.
    return F.when(p > 0, F.greatest(F.log(p), F.lit(LOG_FLOOR))).otherwise(F.lit(LOG_FLOOR))


def binary_cross_entropy(p: Column, y: Column) -> Column:
    return -(y * _clamped_log(p) + (1 - y) * _clamped_log(1 - p))


def binary_cross_entropy_with_logit(x: Column, y: Column) -> Column:
    """Stable for large logits of either sign."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def softmax_cross_entropy(logits: Column, target: Column) -> Column:
    """Log of the softmax denominator minus the target's logit, shifted by the largest logit."""
    largest = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - largest))
    return F.log(total) + largest - F.element_at(logits, (target + 1).cast("int"))


def argmax(logits: Column) -> Column:
    """0-based position of the (first) largest logit."""
    return F.array_position(logits, F.array_max(logits)) - 1


def multi_label_hits(logits: Column, targets: Column) -> Column:
    """How many cells are right when a logit above 0 (a probability above one half) predicts 1."""
    cells = F.zip_with(logits, targets, lambda x, y: F.when((x > 0) == (y > 0.5), 1).otherwise(0))
    return F.aggregate(cells, F.lit(0), lambda acc, hit: acc + hit)


def multi_label_loss(logits: Column, targets: Column) -> Column:
    """Summed loss over the cells of one row."""
    cells = F.zip_with(logits, targets, binary_cross_entropy_with_logit)
    return F.aggregate(cells, F.lit(0.0), lambda acc, loss: acc + loss)
