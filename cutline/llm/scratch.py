"""Intermediate tables in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder.  A table written there cuts the lineage, can
be read by every executor and survives the loss of any of them.  Only in local mode, as in
tests, a temporary folder takes its place where the setting is absent.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_OPEN: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="cutline-")
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one operator call; they go when the Python process ends or on drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cutline/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _OPEN.append(self)
        atexit.register(_delete, spark, self.root)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df and returns what reads it back."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.root)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Drops the tables of what is called inside; what is left of it must have been written elsewhere."""
    before = len(_OPEN)
    yield
    for s in _OPEN[before:]:
        s.drop()
    del _OPEN[before:]
