"""Running values over groups of any size.

A window over a group runs in one task. One person, period or visit may hold a large share of
all rows, so a large group is cut along its sort order into blocks (say, months), each block is
its own window partition, and what a block must know about the blocks before it is carried in
from a summary with one row per block. Groups of ordinary size stay whole, as block 0.
"""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ehrseq.functions.dates import month_number
from ehrseq.operators.sizes import join_lookup
from ehrseq.staging import like_measured, measured

# A person with more rows than this is cut into months, and their visits into blocks of visit keys.
BUSY_PERSON_ROWS = 100_000
# Visits of one day in a block; each day starts a new one. Orders work only.
VISITS_PER_BLOCK = 10_000


class PersonRows(NamedTuple):
    busy: DataFrame | None
    rows: dict[str, int]


def count_person_rows(frames: dict[str, DataFrame], stage, max_rows: int = BUSY_PERSON_ROWS) -> PersonRows:
    """Persons with more than ``max_rows`` rows in all ``frames`` (None when there are none), and the
    rows of each frame, from one pass over all."""
    parts = [frame.select("person_id", F.lit(n).alias("_frame")) for n, frame in enumerate(frames.values())]
    rows = reduce(DataFrame.unionAll, parts).groupBy("person_id")
    counts = rows.agg(F.count("*").alias("_rows"), *[F.count_if(F.col("_frame") == n).alias(f"_rows_{n}") for n in range(len(parts))])
    totals = {name: F.sum(f"_rows_{n}") for n, name in enumerate(frames)}
    is_busy = F.col("person_id").isNotNull() & (F.col("_rows") > max_rows)
    persons = stage.measured(counts, "person_rows", totals | {"_busy": F.count_if(is_busy)})
    seen = dict(measured(persons).values)
    many = seen.pop("_busy")
    busy = like_measured(persons.where(is_busy).select("person_id"), persons, many) if many else None
    return PersonRows(busy, {name: n or 0 for name, n in seen.items()})


def busy_persons(frames: list[DataFrame], stage, max_rows: int = BUSY_PERSON_ROWS) -> DataFrame | None:
    """Persons with more than ``max_rows`` rows in all ``frames``, or None when there are none."""
    return count_person_rows({str(n): frame for n, frame in enumerate(frames)}, stage, max_rows).busy


def add_block(frame: DataFrame, busy: DataFrame | None, block: Column, name: str = "_block") -> DataFrame:
    """``block`` (never 0) for rows of busy persons, 0 for all others."""
    if busy is None:
        return frame.withColumn(name, F.lit(0))
    flagged = join_lookup(frame, like_measured(busy.withColumn("_busy", F.lit(True)), busy), "person_id", "left")
    return flagged.withColumn(name, F.when(F.col("_busy"), block).otherwise(F.lit(0))).drop("_busy")


def month_block(frame: DataFrame, busy: DataFrame | None, date: str) -> DataFrame:
    return add_block(frame, busy, month_number(F.col(date)))


def visit_block(frame: DataFrame, busy: DataFrame | None) -> DataFrame:
    """Blocks in the order of ``visit_seq``: a day, and within a day so many visits."""
    return add_block(frame, busy, 2 * F.floor(F.col("visit_seq") / VISITS_PER_BLOCK) + 1)


def blocks_before(summary: DataFrame, keys: list[str], block: str | list[str], **carried: Column) -> DataFrame:
    """Aggregate, for each block, all earlier blocks of its group.

    ``summary`` has one row per group and block; ``carried`` maps result names to aggregates.
    """
    order = [block] if isinstance(block, str) else block
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*keys, *order, *[agg.over(earlier).alias(name) for name, agg in carried.items()])


def carry_in(frame: DataFrame, busy: DataFrame | None, keys: list[str], name: str, value: Column, kind: str) -> DataFrame:
    """Add ``name``: the largest ``value`` in the earlier blocks of the group, null if there are none."""
    if busy is None:
        return frame.withColumn(name, F.lit(None).cast(kind))
    largest = frame.where("_block <> 0").groupBy(*keys, "_block").agg(F.max(value).alias("_largest"))
    before = blocks_before(largest, keys, "_block", **{name: F.max("_largest")})
    return frame.join(before, [*keys, "_block"], "left")


def number_rows(frame: DataFrame, name: str, keys: list[str], block: str | list[str], order: list) -> DataFrame:
    """1-based row number per group in the order (``block``, ``order``), with groups cut into blocks.

    Keys and blocks must not be null.
    """
    blocks = [block] if isinstance(block, str) else block
    sizes = frame.groupBy(*keys, *blocks).agg(F.count("*").alias("_rows"))
    before = blocks_before(sizes, keys, blocks, _before=F.sum("_rows"))
    within = Window.partitionBy(*keys, *blocks).orderBy(*order)
    number = F.coalesce("_before", F.lit(0)) + F.row_number().over(within)
    return (
        frame.join(before, [*keys, *blocks], "left").withColumn(name, number.cast("bigint")).drop("_before")
    )
