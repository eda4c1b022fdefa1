"""Intermediate tables shared by several branches of a job.

A frame that feeds more than one branch would be computed once per branch. Writing it as a
table in the folder the cluster names in ``spark.checkpoint.dir`` computes it once, cuts the
lineage, survives lost executors, and lets each reader prune columns and push filters down.
"""

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import cache
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Measured(NamedTuple):
    """What is known of a staged table since it was written."""

    rows: int
    bytes: int
    values: dict[str, Any]


def measured(frame: DataFrame) -> Measured | None:
    """What is known of a staged table, None for any other frame."""
    return frame.__dict__.get("_measured")


def like_measured(frame: DataFrame, source: DataFrame, rows: int | None = None) -> DataFrame:
    """``frame``, which has about a row for each of ``source`` (or ``rows`` of them), with what is known of ``source``."""
    known = measured(source)
    frame.__dict__["_measured"] = known if rows is None else known._replace(rows=rows)
    return frame


@cache
def _trial_folder():
    folder = tempfile.mkdtemp(prefix="ehrseq-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def output_exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


class Staging:
    """Writes staged tables below one folder of the session's shared checkpoint directory.

    As a context, it deletes its folder at the end: leave it when the results are written.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            root = _trial_folder()
        self._spark = spark
        self.folder = f"{root.rstrip('/')}/ehrseq-{uuid.uuid4().hex}"

    def __call__(self, frame: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
        """``schema`` names types that are stored as others, as those of the columns read back."""
        path = f"{self.folder}/{name}"
        frame.write.parquet(path)
        return self._spark.read.schema(schema or frame.schema).parquet(path)

    def measured(self, frame: DataFrame, name: str, values: dict[str, Column] | None = None) -> DataFrame:
        """Write ``frame`` and know its rows and bytes, and aggregates of the columns that were written.

        They come from what was written (the rows from the file footers), not from counters of the
        tasks, which count a repeated task again.
        """
        result = self(frame, name)
        aggregates = [value.alias(n) for n, value in (values or {}).items()]
        seen = result.agg(F.count(F.lit(1)).alias("_rows"), *aggregates).first().asDict()
        result.__dict__["_measured"] = Measured(seen.pop("_rows"), self._bytes(f"{self.folder}/{name}"), seen)
        return result

    def finish(self, write: Callable[[], None], name: str) -> None:
        """Run ``write``, which leaves results outside the folder."""
        write()

    def _bytes(self, path: str) -> int:
        files, place = _place(self._spark, path)
        return files.getContentSummary(place).getLength()

    def __enter__(self) -> "Staging":
        return self

    def __exit__(self, *error) -> None:
        self.delete()

    def delete(self) -> None:
        """Remove the staged tables. Frames that read them can no longer be computed."""
        files, place = _place(self._spark, self.folder)
        files.delete(place, True)


class ResumableStaging(Staging):
    """Staged tables that a later run of the same job takes up where this one stopped.

    ``identity`` says what the tables follow from (see ``identity_of``). A finished table
    has a manifest beside it with the identity, its schema and what is known of it. A table whose
    manifest agrees is read, and what it would be computed from is not; any other is written anew.
    Names must be the same from run to run.
    """

    def __init__(self, spark: SparkSession, folder: str, identity: str):
        self._spark, self.folder, self._identity = spark, folder.rstrip("/"), identity

    def is_new(self) -> bool:
        """Whether no earlier run left anything."""
        return not output_exists(self._spark, self.folder)

    def _manifest(self, name: str) -> dict | None:
        path = f"{self.folder}/{name}.manifest"
        if not output_exists(self._spark, f"{path}/_SUCCESS"):
            return None
        found = json.loads(self._spark.read.text(path).first()["value"])
        return found if found["identity"] == self._identity else None

    def _finished(self, name: str, facts: dict) -> None:
        text = json.dumps({"identity": self._identity, **facts})
        self._spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}.manifest")

    def _clear(self, name: str) -> None:
        for path in (f"{self.folder}/{name}.manifest", f"{self.folder}/{name}"):
            files, place = _place(self._spark, path)
            files.delete(place, True)

    def _read(self, found: dict, name: str) -> DataFrame:
        return self._spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{self.folder}/{name}")

    def __call__(self, frame: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
        found = self._manifest(name)
        if found is not None:
            return self._read(found, name)
        self._clear(name)
        result = super().__call__(frame, name, schema)
        self._finished(name, {"schema": result.schema.jsonValue()})
        return result

    def measured(self, frame: DataFrame, name: str, values: dict[str, Column] | None = None) -> DataFrame:
        found = self._manifest(name)
        if found is None:
            self._clear(name)
            result = _Unmarked(self).measured(frame, name, values)
            self._finished(name, {"schema": result.schema.jsonValue(), "measured": measured(result)})
            return result
        result = self._read(found, name)
        result.__dict__["_measured"] = Measured(*found["measured"])
        return result

    def finish(self, write: Callable[[], None], name: str) -> None:
        """Run ``write`` unless an earlier run did; what it writes must replace what is there."""
        if self._manifest(name) is None:
            write()
            self._finished(name, {})


class _Unmarked(Staging):
    """Plain writes below the folder of another staging."""

    def __init__(self, other: Staging):
        self._spark, self.folder = other._spark, other.folder


def identity_of(spark: SparkSession, settings: dict, folders: list[str]) -> str:
    """A hash of the settings and, of every source folder that is there, its length, its number of
    files and its time of change: a few calls per folder, however many files it has."""
    seen = []
    for folder in folders:
        files, place = _place(spark, folder)
        if files.exists(place):
            summary = files.getContentSummary(place)
            seen.append([folder, summary.getLength(), summary.getFileCount(), files.getFileStatus(place).getModificationTime()])
    return hashlib.sha256(json.dumps([settings, seen], sort_keys=True).encode()).hexdigest()
