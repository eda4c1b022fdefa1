"""Reproducible draws in place of a random number generator.

A draw is a hash of a seed, the keys of the row and the name of the decision, so a retried
task draws the same values and any engine with MD5 can repeat them.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *keys: str | Column) -> Column:
    """A value in [0, 1) for one decision (``stream``) about the row named by ``keys``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(stream))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


def whole_number(low: Column, high: Column, draw: Column) -> Column:
    """Turn a draw into a whole number between ``low`` and ``high``, both included."""
    return (low + F.floor(draw * (high - low + 1))).cast("bigint")
