"""What the operators share at run time: cutting lineage, and broadcasts of checked size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from polyad.errors import InvalidParameterError

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a temporary folder serves a local master; a cluster without it is an error,
    for a folder of one machine would lose data with that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise InvalidParameterError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="polyad-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def _path(spark: SparkSession, path: str):
    """A Hadoop path with the file system that it belongs to, which need not be named in it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_mounted(spark: SparkSession) -> bool:
    """Whether the shared folder is one of files, so that workers can open what lies there by its plain path.

    A root without a scheme belongs to the cluster's default file system, which need not be that of files.
    """
    path, fs = _path(spark, shared_root(spark))
    return fs.makeQualified(path).toUri().getScheme() == "file"


def session_root(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_root(spark)}/polyad/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends, and later reads don't recompute it.

    A table on the shared folder survives the loss of any executor. ``release`` removes the tables.
    """
    return _written(df, _new_path(df.sparkSession))


def _new_path(spark: SparkSession) -> str:
    return f"{session_root(spark)}/{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def exists(spark: SparkSession, name: str) -> bool:
    """Whether a file or folder is there."""
    path, fs = _path(spark, name)
    return fs.exists(path)


def new_folder(spark: SparkSession) -> str:
    """The name of a folder in the shared folder that isn't there yet; ``release`` removes it."""
    return _new_path(spark)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that ``cut`` wrote."""
    for name in paths:
        path, fs = _path(spark, name)
        fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove every table that ``cut`` wrote in this application."""
    drop(spark, [session_root(spark)])


class Rounds:
    """Tables of a loop: the table of round k is removed once that of round k + 2 is written.

    Round k + 1 may still be compared with k; whatever the caller keeps must be written by ``cut`` itself
    or be the table of the last round.
    """

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        spark, path = df.sparkSession, _new_path(df.sparkSession)
        found = _written(df, path)
        self.paths.append((spark, path))
        while len(self.paths) > 2:
            old, gone = self.paths.pop(0)
            drop(old, [gone])
        return found


def bounded_rows(df: DataFrame, bound: int, what: str) -> list:
    """Rows of a result that has at most ``bound`` of them by construction; more is an error, never a cut."""
    rows = df.take(bound + 1)
    if len(rows) > bound:
        raise InvalidParameterError(f"{what}: more than {bound} rows; this step needs a bounded input")
    return rows
