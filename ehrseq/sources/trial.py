"""CDM tables derived from order and customer tables, so that trials run on real-sized data.

Customers act as persons, orders as visits, order lines as clinical events and parts as drugs.
The rules produce every case the jobs must handle: events with and without a visit, copies,
missing birth dates, drugs with no or several ingredients.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ehrseq.operators.cohort import gender_concept
from ehrseq.sources.cdm import conform


SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def _days(column):
    return column.cast("int")


def person(spark, folder):
    key = F.col("c_custkey")
    return conform(
        read(spark, folder, "customer").select(
            key.alias("person_id"),
            (1930 + key % 70).alias("year_of_birth"),
            F.nullif(key % 13, F.lit(0)).alias("month_of_birth"),
            F.nullif(key % 32, F.lit(0)).alias("day_of_birth"),
            gender_concept(key % 2).alias("gender_concept_id"),
        ),
        "person",
    )


def observation_period(spark, folder):
    spans = F.array(
        F.struct(F.lit(1).alias("k"), F.lit("1995-01-01").alias("s"), F.lit("1996-12-31").alias("e")),
        F.struct(F.lit(2).alias("k"), F.lit("1998-01-01").alias("s"), F.lit("2000-12-31").alias("e")),
    )
    periods = read(spark, folder, "customer").where("c_acctbal >= 0").select("c_custkey", F.explode(spans).alias("p"))
    return conform(
        periods.select(
            F.col("c_custkey").alias("person_id"),
            (F.col("c_custkey") * 10 + F.col("p.k")).alias("observation_period_id"),
            F.col("p.s").alias("observation_period_start_date"),
            F.col("p.e").alias("observation_period_end_date"),
        ),
        "observation_period",
    )


def visit_occurrence(spark, folder):
    start = F.col("o_orderdate").cast("date")
    priority = F.col("o_orderpriority")
    return conform(
        read(spark, folder, "orders")
        .where(priority != "5-LOW")
        .select(
            F.col("o_custkey").alias("person_id"),
            F.col("o_orderkey").alias("visit_occurrence_id"),
            start.alias("visit_start_date"),
            F.date_add(start, _days(F.col("o_orderkey") % 5 * 7)).alias("visit_end_date"),
            F.when(priority.isin("1-URGENT", "2-HIGH"), 9203)
            .when(priority == "3-MEDIUM", 9202)
            .otherwise(9201)
            .alias("visit_concept_id"),
        ),
        "visit_occurrence",
    )


def _event_base(spark, folder):
    lines = read(spark, folder, "lineitem").join(
        read(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    copies = F.when(F.col("l_quantity") > 47, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return lines.withColumn("_copy", F.explode(copies)).select(
        F.col("o_custkey").alias("person_id"),
        F.col("l_shipdate").cast("date").alias("start_date"),
        F.when(F.col("l_linenumber").isin(1, 4, 7), F.col("l_orderkey")).alias("visit_occurrence_id"),
        F.when(F.col("l_discount") == 0, 0).otherwise(1000000 + F.col("l_partkey") % 100).alias("concept_id"),
        (2000000 + F.col("l_partkey")).alias("drug_id"),
        "l_returnflag",
        "l_linestatus",
    )


def _domain(spark, folder, table, condition, date_column, concept_column, concept="concept_id"):
    return conform(
        _event_base(spark, folder)
        .where(condition)
        .select(
            "person_id",
            F.col("start_date").alias(date_column),
            F.col(concept).alias(concept_column),
            "visit_occurrence_id",
        ),
        table,
    )


def condition_occurrence(spark, folder):
    return _domain(
        spark, folder, "condition_occurrence", "l_returnflag = 'A'", "condition_start_date", "condition_concept_id"
    )


def drug_exposure(spark, folder):
    return _domain(
        spark,
        folder,
        "drug_exposure",
        "l_returnflag = 'R'",
        "drug_exposure_start_date",
        "drug_concept_id",
        concept="drug_id",
    )


def measurement(spark, folder):
    return _domain(
        spark,
        folder,
        "measurement",
        "l_returnflag = 'N' AND l_linestatus = 'F'",
        "measurement_date",
        "measurement_concept_id",
    )


def procedure_occurrence(spark, folder):
    return _domain(
        spark,
        folder,
        "procedure_occurrence",
        "l_returnflag = 'N' AND l_linestatus = 'O'",
        "procedure_date",
        "procedure_concept_id",
    )


def death(spark, folder):
    day = F.date_add(F.lit("2000-06-15").cast("date"), _days(F.col("c_custkey") % 100))
    return conform(
        read(spark, folder, "customer")
        .where("c_acctbal > 9600")
        .select(F.col("c_custkey").alias("person_id"), day.alias("death_date")),
        "death",
    )


def _brand_number():
    return F.substring_index("p_brand", "#", -1).cast("bigint")


def concept(spark, folder):
    part = read(spark, folder, "part")
    ingredients = part.select(
        (3000000 + _brand_number()).alias("concept_id"), F.lit("Ingredient").alias("concept_class_id")
    ).distinct()
    drugs = part.select(
        (2000000 + F.col("p_partkey")).alias("concept_id"), F.lit("Clinical Drug").alias("concept_class_id")
    )
    return conform(ingredients.unionByName(drugs), "concept")


def concept_ancestor(spark, folder):
    """Most parts have their brand as ingredient, small ones a second, and each drug an ancestor
    that is no ingredient."""
    brand = _brand_number()
    drug = 2000000 + F.col("p_partkey")
    ancestors = F.array(
        F.when(F.col("p_size") < 50, 3000000 + brand),
        F.when(F.col("p_size") <= 5, 3000000 + brand % 25 + 1),
        drug,
    )
    pairs = read(spark, folder, "part").select(
        F.explode(ancestors).alias("ancestor_concept_id"), drug.alias("descendant_concept_id")
    )
    return conform(pairs.where("ancestor_concept_id IS NOT NULL"), "concept_ancestor")


def labels(spark, folder):
    return (
        read(spark, folder, "customer")
        .where("c_mktsegment <> 'MACHINERY'")
        .select(F.col("c_custkey").alias("person_id"), (F.col("c_acctbal") > 5000).alias("label"))
    )


def cdm_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    builders = {
        "person": person,
        "observation_period": observation_period,
        "visit_occurrence": visit_occurrence,
        "condition_occurrence": condition_occurrence,
        "drug_exposure": drug_exposure,
        "measurement": measurement,
        "procedure_occurrence": procedure_occurrence,
        "death": death,
        "concept": concept,
        "concept_ancestor": concept_ancestor,
    }
    return {name: build(spark, folder) for name, build in builders.items()}


def epoch_predictions(spark, folder):
    """Order lines as predictions of three epochs, on training and other orders, from two runs."""
    price = F.col("l_extendedprice")
    return read(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("pretrained_model"),
        (F.col("l_linenumber") % 3).cast("bigint").alias("epoch"),
        (F.col("l_orderkey") % 5 != 0).alias("is_train"),
        (F.col("l_orderkey") % 2).cast("int").alias("run"),
        (price / (price + 50000.0)).alias("prediction"),
        (F.col("l_tax") >= 0.05).cast("int").alias("label"),
    )
