"""Broadcasts only behind a check of the size, and cuts as fine as the rows need."""

from pyspark.sql import DataFrame

from ehrseq.staging import measured

BROADCAST_ROWS = 1_000_000
# Of the written table; rows in memory take a few times that.
BROADCAST_BYTES = 128 << 20
# Rows that sort or meet in one task, on average; orders work only.
ROWS_PER_TASK = 500_000


def known_rows(*frames: DataFrame) -> int | None:
    """Rows of all ``frames`` together, None if those of one are not known."""
    found = [measured(frame) for frame in frames]
    return None if None in found else sum(known.rows for known in found)


def cut(frame: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``frame``, of about ``rows`` rows, cut by ``keys`` into tasks of ``ROWS_PER_TASK`` rows.

    Adaptive execution merges what is cut up to a number of bytes as they were sent. Narrow rows are many
    times that in memory, so the memory of a task would grow with the tables. Frames of few rows, or of
    unknown size, are left to it.
    """
    tasks = -(-(rows or 0) // ROWS_PER_TASK)
    few = tasks <= frame.sparkSession.sparkContext.defaultParallelism
    return frame if few else frame.repartition(tasks, *keys)


def join_lookup(frame: DataFrame, lookup: DataFrame, on, how: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large frame to a narrow lookup table.

    A lookup of at most ``max_rows`` rows is broadcast, so hot keys of the large side cost nothing.
    A larger one is joined by shuffle, where adaptive execution splits the partitions of hot keys.
    The size of a table of ``Staging.measured`` is known from its write and costs nothing; any other
    lookup is computed once more to count its rows.
    """
    known = measured(lookup)
    small = lookup.count() <= max_rows if known is None else known.rows <= max_rows and known.bytes <= BROADCAST_BYTES
    return frame.join(lookup.hint("broadcast" if small else "shuffle_merge"), on, how)
