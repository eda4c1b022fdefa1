"""Sequences, vocabularies, metric rows and run records on disk."""

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sequences(sequences: DataFrame, path: str, mode: str = "error") -> None:
    sequences.write.mode(mode).parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.write.parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_vocabulary_json(vocabulary: DataFrame, path: str) -> None:
    """JSON lines of word and index, written by the tasks."""
    vocabulary.write.json(path)


def import_vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, token_id bigint").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as CSV with a header."""
    metrics.write.option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str, schema: str, **ids) -> DataFrame:
    """Metric rows of one experiment, with the columns that tell which experiment it was."""
    rows = spark.read.option("header", True).schema(schema).csv(path)
    return rows.select("*", *[F.lit(value).alias(name) for name, value in ids.items()])


def append_score_counts(counts: DataFrame, path: str) -> None:
    """Add the score counts of one more run to those at ``path``."""
    counts.write.mode("append").parquet(path)


def read_score_counts(spark: SparkSession, path: str) -> DataFrame:
    """The score counts of all runs at ``path``, to be merged."""
    return spark.read.parquet(path)


def scan_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Metric rows of all experiments below ``root`` in one scan, with folder and test label.

    Expects what ``write_metrics`` leaves at ``<root>/<evaluation folder>/evaluation<test label>``.
    """
    path, pattern = F.col("_metadata.file_path"), r"/(eval_[^/]+)/evaluation([^/]+)/[^/]+$"
    rows = spark.read.option("header", True).schema(schema).csv(f"{root}/eval_*/evaluation*")
    return rows.select(
        "*",
        F.regexp_extract(path, pattern, 1).alias("evaluation_folder"),
        F.regexp_extract(path, pattern, 2).alias("test_label"),
    )


def write_record(spark: SparkSession, settings, path: str, mode: str = "error") -> None:
    """The options of a run, beside its output."""
    text = json.dumps(asdict(settings), sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def read_record(spark: SparkSession, settings_class, path: str):
    return settings_class(**json.loads(spark.read.text(path).first()["value"]))
