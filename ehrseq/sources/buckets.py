"""Tables cut by person once, when they are written, so that later jobs need not shuffle by person.

A bucketed table needs a catalog that keeps its bucket specification between sessions, such as a Hive
metastore; Spark's in-memory catalog keeps it for the session. All tables of a data set get the
same number of buckets, or joins shuffle one of them again. Jobs use the buckets of several keys
with ``spark.sql.requireAllClusterKeysForCoPartition`` off (see ``session.SETTINGS``).

A bucket is read by one task, so a person with a large share of all rows is one task's work: where
``count_person_rows`` finds such persons, read with ``bucketed=False``, which scans the same files as
any others.
"""

from pyspark.sql import DataFrame, SparkSession

from ehrseq.schema import CDM_SCHEMA, SEQUENCE_TABLE
from ehrseq.sources.cdm import conform

# Rows of the largest table in a bucket, which one task sorts and joins.
ROWS_PER_BUCKET = 500_000


def buckets_for(rows: int, least: int = 1) -> int:
    """So many buckets that the task of one holds no more when the tables grow: for tables of at most ``rows`` rows."""
    return max(least, -(-rows // ROWS_PER_BUCKET))


def write_bucketed(tables: dict[str, DataFrame], path: str, prefix: str, buckets: int, by: str = "person_id") -> None:
    """Each table as ``<prefix>_<name>`` in the catalog and a folder below ``path``, bucketed and sorted by person.

    ``by`` is the person that later jobs group by: of events attached to visits, ``visit_person_id``.

    Rows meet by person before the write, so a bucket has few files; adaptive execution splits
    the partition of a person with very many rows.
    """
    for name, frame in tables.items():
        writer = frame.hint("rebalance", by).write.format("parquet").option("path", f"{path}/{name}")
        writer.bucketBy(buckets, by).sortBy(by).saveAsTable(f"{prefix}_{name}")


def read_bucketed(spark: SparkSession, path: str, prefix: str, names: list[str], bucketed: bool = True) -> dict[str, DataFrame]:
    """Tables that ``write_bucketed`` wrote, by name."""
    return {name: spark.table(f"{prefix}_{name}") if bucketed else spark.read.parquet(f"{path}/{name}") for name in names}


def write_cdm_bucketed(tables: dict[str, DataFrame], path: str, prefix: str, buckets: int) -> None:
    """The tables of a data set that have persons; the others are small."""
    write_bucketed({n: conform(t, n) for n, t in tables.items() if "person_id" in CDM_SCHEMA[n]}, path, prefix, buckets)


def write_sequences_bucketed(sequences: DataFrame, path: str, prefix: str, buckets: int) -> None:
    write_bucketed({SEQUENCE_TABLE: sequences}, path, prefix, buckets)


def drop_bucketed(spark: SparkSession, prefix: str, names: list[str]) -> None:
    """Forget the tables. Their files stay where they are."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")
