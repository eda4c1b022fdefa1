"""Run named queries in Spark and their SQL in DuckDB and compare the rows."""

import glob
import os

import duckdb


def connect(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def kind(duck_type):
    """The Spark name of a DuckDB type; types that have none are returned as they are."""
    return {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}.get(duck_type, duck_type)


def _key(row):
    return tuple((value is None, "" if value is None else str(value)) for value in row)


def differences(spark_frame, connection, sql):
    """What is not alike, as short texts; empty when the two agree."""
    names = sorted(spark_frame.columns)
    relation = connection.sql(sql)
    found = []
    if names != sorted(relation.columns):
        return [f"columns {names} != {sorted(relation.columns)}"]
    spark_types = dict(spark_frame.dtypes)
    for name, duck_type in zip(relation.columns, relation.types):
        if spark_types[name] != kind(str(duck_type)):
            found.append(f"type of {name}: {spark_types[name]} != {duck_type}")
    ours = sorted((tuple(row) for row in spark_frame.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    picked = ", ".join(f'"{n}"' for n in names)
    theirs = sorted(connection.sql(f"SELECT {picked} FROM ({sql})").fetchall(), key=_key)
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} != {len(theirs)}")
    unequal = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if unequal:
        found.append(f"{len(unequal)} rows differ, first {unequal[0]}")
    return found
