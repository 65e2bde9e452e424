"""Tables that a job writes between its steps, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, deleted when the Python process ends.

    Only a local session may leave the setting out: it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="cutline-")
    at = f"{root.rstrip('/')}/cutline/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, at)
    return at


def _delete(spark: SparkSession, at: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: what follows does not repeat the work before."""
    at = place(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


_ONCE: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, source: str) -> tuple[int, int, int]:
    """Bytes, files and last change of a folder: other contents are another source."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = fs.getContentSummary(path)
    return whole.getLength(), whole.getFileCount(), max((s.getModificationTime() for s in fs.listStatus(path)), default=0)


def once(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A staged table that several jobs of one application share, made by the first of them, and again when its source has changed."""
    key = (spark.sparkContext.applicationId, name, source, _state(spark, source))
    if key not in _ONCE:
        _ONCE[key] = stage(build(), name)
    return _ONCE[key]
