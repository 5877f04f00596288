"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet there, so a lost executor costs only the
tasks that ran on it and never a written stage. Every application has a folder
of its own below it.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Paths given out inside the innermost ``temporary``.
_MADE: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs in one process."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lithos-")
    return _OWN[app]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lithos-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside at its end; what reads them must have been written elsewhere by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            delete(spark, path)


def tune(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Smaller batches between JVM and Python, by rows and by bytes, as rows are whole texts or sets of them.

    A setting of the session's own stays. It holds for the session, as plans run later.
    """
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1), size)):
        if spark.conf.get(key, None) in (None, default):
            spark.conf.set(key, str(value))


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results that still read them become invalid."""
    delete(spark, _folder(spark))
