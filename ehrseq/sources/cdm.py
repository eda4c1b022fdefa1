"""Common-data-model tables as frames with known columns and types."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ehrseq.schema import CDM_SCHEMA, PATIENT_TABLES


def conform(frame: DataFrame, table: str) -> DataFrame:
    """Keep the columns the jobs use, cast to their types (dates from timestamps included)."""
    return frame.select(*[F.col(c).cast(t).alias(c) for c, t in CDM_SCHEMA[table].items()])


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return conform(spark.read.parquet(f"{root}/{table}"), table)


def read_cdm(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every patient table that exists below ``root``; a missing table is simply not there."""
    tables = {}
    for table in PATIENT_TABLES:
        try:
            tables[table] = read_table(spark, root, table)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return tables


def write_cdm(tables: dict[str, DataFrame], root: str) -> None:
    """One folder per table."""
    for name, frame in tables.items():
        frame.write.parquet(f"{root}/{name}")


def read_labels(spark: SparkSession, path: str, concept_id: int | None = None) -> DataFrame:
    """Labels of one predicted concept (a partition filter), or of a folder that holds just one.

    A folder cut by concept needs to be told which: its concepts together would label a person
    several times, and each label repeats all of the person's tokens.
    """
    labels = spark.read.parquet(path)
    if concept_id is not None:
        labels = labels.where(F.col("concept_id") == concept_id)
    elif "concept_id" in labels.columns:
        raise ValueError(f"{path} holds labels of several concepts: name one")
    return labels.select(F.col("person_id").cast("bigint"), F.col("label").cast("boolean"))


def read_all_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of every predicted concept, with the concept."""
    labels = spark.read.parquet(path)
    return labels.select(F.col("concept_id").cast("bigint"), F.col("person_id").cast("bigint"), F.col("label").cast("boolean"))


def write_labels(labels: DataFrame, path: str) -> None:
    """One folder per predicted concept. The rows of a concept stay spread over many tasks."""
    labels.write.partitionBy("concept_id").parquet(path)
