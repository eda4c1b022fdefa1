"""Connected components of an edge table by alternating large and small stars.

Each round re-hangs edges under the smallest neighbour; after a few rounds every component is a
star around its smallest vertex. Each round is written as a table, so lost executors cost a round
at most. Minima are aggregated before the shuffle, and the joins are plain equi-joins that
adaptive execution can split, so a vertex may have any number of edges.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrseq.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each larger neighbour of a vertex under the vertex's smallest neighbour (or itself)."""
    both = edges.unionAll(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("least").alias("low"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a vertex and its smaller neighbours under the smallest of these."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high").where("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionAll(least.toDF("high", "low"))


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (vertex, root) for every vertex of an edge; root is the component's smallest.

    Repeated edges and loops are allowed; null ends are left out.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    now = stage(now.distinct(), "edges_0")
    before, number = None, 0
    while (state := _state(now)) != before:
        before, number = state, number + 1
        now = stage(_small_star(_large_star(now).distinct()).distinct(), f"edges_{number}")
    return now.toDF("vertex", "root").unionAll(now.select("low", "low").distinct())
