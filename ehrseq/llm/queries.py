"""One query per text operator, over its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ehrseq.llm.decontamination import find_passages
from ehrseq.llm.grading import fit_grades, grade_documents, grade_of
from ehrseq.llm.html_text import extract_text
from ehrseq.llm.lm import backoff_scores
from ehrseq.llm.packing import pack_documents
from ehrseq.llm.pii import find_personal_data
from ehrseq.llm.prefix_trie import conversation_trie
from ehrseq.llm.quality import quality_rules
from ehrseq.llm.ranked_search import ranked_search
from ehrseq.llm.sharding import shuffle_into_shards
from ehrseq.llm.simhash import near_duplicates
from ehrseq.llm.toxicity import fit_toxicity, score_toxicity
from ehrseq.llm.url_filters import judge_urls

# Host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
SHARDS = 16
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def url_filters(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(read(spark, folder, "pages"), rules)


def sharding(spark, folder):
    """``rows`` law: shard sizes differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    digests = read(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    placed = shuffle_into_shards(digests, SHARDS)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def simhash(spark, folder):
    return near_duplicates(read(spark, folder, "documents"))


def quality(spark, folder):
    judged = quality_rules(read(spark, folder, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_divergence", "word_divergence")})


def decontamination(spark, folder):
    return find_passages(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def html_extraction(spark, folder):
    return extract_text(read(spark, folder, "pages"))


def lm_scoring(spark, folder):
    scores = backoff_scores(read(spark, folder, "documents"))
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def grading(spark, folder):
    docs = read(spark, folder, "documents")
    ratings = read(spark, folder, "labels").select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return grade_documents(docs, fit_grades(docs, ratings, grades=3), good=2)


def pii(spark, folder):
    return find_personal_data(read(spark, folder, "documents")).drop("redacted")


def packing(spark, folder):
    return pack_documents(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), END_ID, digest=True)


def search(spark, folder):
    return ranked_search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def conversation_prefixes(spark, folder):
    conv = F.col("conv_id")
    most = F.crc32(F.encode(conv.cast("string"), "UTF-8")) % 9
    return conversation_trie(read(spark, folder, "conversations"), donor=conv - conv % 5, most=most, at_most=8)


def toxicity(spark, folder):
    """Labels of the third of the ids that is held out are never read."""
    docs, held_out = read(spark, folder, "documents"), F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    model = fit_toxicity(docs, read(spark, folder, "labels"), learn=~held_out)
    return score_toxicity(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_url_filters": url_filters,
    "op2_sharding": sharding,
    "op3_simhash": simhash,
    "op4_quality_rules": quality,
    "op5_html_extraction": html_extraction,
    "op6_lm_scoring": lm_scoring,
    "op7_decontamination": decontamination,
    "op8_pii": pii,
    "op9_quality_grades": grading,
    "op10_packing": packing,
    "op11_ranked_search": search,
    "op12_prefix_trie": conversation_prefixes,
    "op13_toxicity": toxicity,
}
