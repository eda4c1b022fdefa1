"""From documents to packed sequences, in five stages.

Each stage reads what its predecessor kept and returns the columns of ``documents``; the last
returns pieces and their places. Stages are written as Parquet in the shared checkpoint folder and
read again, so a lost executor costs a stage's tasks and nothing before them.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ehrseq.llm.common import stage
from ehrseq.llm.decontamination import without_passages
from ehrseq.llm.near_copies import without_near_copies
from ehrseq.llm.packing import pack_documents
from ehrseq.llm.pii import documents_redacted
from ehrseq.llm.quality import documents_kept
from ehrseq.llm.queries import END_ID, TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return documents_kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return documents_redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents and their places in sequences."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID, digest=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

# Training, fingerprints and tokens are beyond SQL; the tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
