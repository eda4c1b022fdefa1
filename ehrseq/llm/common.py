"""Small helpers shared by the text operators."""

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrseq.staging import Staging

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word is a run of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Rows turned into Python objects at a time; orders work only.
ROWS_AT_ONCE = 256
# Whole texts travel to Python so many at a time, on either side of the pipe.
ROWS_PER_BATCH = 512
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def lowered(text: str) -> str:
    """Python's counterpart of ``lower_ascii``: bytes.lower() knows ASCII letters only."""
    return text.encode().lower().decode()


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared checkpoint folder and read it back: computed once, lineage cut."""
    return Staging(frame.sparkSession)(frame, name)


def _batch_by_texts(spark) -> None:
    """Spark's default of 10,000 rows a batch is for narrow rows: of texts it holds tens of MB in each
    worker, which the worker keeps. A session with a setting of its own keeps that."""
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(ROWS_PER_BATCH))


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def map_rows(frame: DataFrame, each: Callable[[Iterator[list]], Iterator[dict]], schema: str) -> DataFrame:
    """Run ``each`` over lists of row tuples of a partition; it yields dicts of output columns
    (lists, numpy or Arrow arrays).

    Texts become Python objects a few hundred rows at a time, so memory follows the longest
    texts and not the Arrow batch.
    """
    out = frame.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def pieces(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                columns = [c.slice(at, ROWS_AT_ONCE).to_pylist() for c in batch.columns]
                yield list(zip(*columns))

    def run(batches):
        for columns in each(pieces(batches)):
            yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()

    _batch_by_texts(frame.sparkSession)
    return frame.mapInArrow(run, out)


def edit_rows(docs: DataFrame, columns: list[str], decide: Callable[[list], tuple[list[bool], dict[str, list]]]) -> DataFrame:
    """Drop rows or replace values of ``docs`` by looking at some of its columns.

    ``decide`` gets a list of tuples of these columns; it returns which rows stay, and new values
    (for all rows) of the columns that change. All other columns pass through untouched, whatever
    their names and types.
    """
    places = [docs.columns.index(c) for c in columns]
    names = list(docs.columns)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                stay, new = decide(list(zip(*(part.column(n).to_pylist() for n in places))))
                for name, values in new.items():
                    n = names.index(name)
                    part = part.set_column(n, part.schema.field(n), pa.array(values, part.schema.field(n).type))
                yield part.filter(pa.array(stay))
        pa.default_memory_pool().release_unused()

    _batch_by_texts(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
