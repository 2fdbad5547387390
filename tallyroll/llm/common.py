"""Helpers shared by the operators: tables, shared work folders, sizing."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
#: Spark's setting that frees the shuffle files of a query when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder that driver and executors share.

    It lies under ``spark.checkpoint.dir``.  Only where that is unset on one machine (tests)
    a local temporary folder is used instead.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"tallyroll-{os.getpid()}")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings are these inside a ``with`` block, and as before after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Lists that ``written`` adds its folders to, see ``noting``.
_NOTED: list[list[str]] = []


@contextlib.contextmanager
def noting():
    """The list of the folders that ``written`` makes inside a ``with`` block."""
    folders: list[str] = []
    _NOTED.append(folders)
    try:
        yield folders
    finally:
        _NOTED.pop()


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders; those that are gone already are passed over.  The list is emptied."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends there.

    The shuffle files of the write go when it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = work_dir(spark, tag)
    for folders in _NOTED:
        folders.append(path)
    with settings(spark, {CLEAN_SHUFFLES: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def lean(f):
    """An Arrow function (of batches or of a group) after which its worker gives freed memory back to the system.

    Workers outlive their tasks; without this what one step's arrays took stays with them through all later steps.
    """
    if inspect.isgeneratorfunction(f):

        def run(batches):
            yield from f(batches)
            _give_back()

    else:

        def run(part):
            out = f(part)
            _give_back()
            return out

    return run


def discard(*frames: DataFrame) -> None:
    """Deletes the files of ``written`` frames that nothing will read again."""
    for df in frames:
        delete(df.sparkSession, list({f.rsplit("/", 1)[0] for f in df.inputFiles()}))
