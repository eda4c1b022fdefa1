"""Fixed-length input arrays. All arrays here are bounded by the maximum sequence length."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_and_pad(values: Column, prefix: Column, padding: Column, max_length: int) -> Column:
    """One prefix value, the values, then padding on the right up to ``max_length``."""
    missing = F.greatest(F.lit(0), F.lit(max_length - 1) - F.size(values))
    return F.concat(F.array(prefix), values, F.array_repeat(padding, missing))


def relative_orders(orders: Column) -> Column:
    """Visit orders counted from 1 within the slice."""
    smallest = F.array_min(orders)
    return F.transform(orders, lambda order: order - smallest + 1)
