"""Cutting lineage with tables written to the folder all executors share.

A written table survives the loss of executors and, unlike an RDD checkpoint,
is compressed and keeps column pruning and filter pushdown for its readers. It
is deleted by released() or release(), else when the interpreter ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

_written: list[tuple[SparkSession, str]] = []
_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset, as in tests on one machine."""
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="assay-")
    return _own


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written once to the shared folder and read back: later plans start there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/assay-{uuid.uuid4().hex}/{name}"
    ship(spark)
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released() -> Iterator[None]:
    """Tables cut inside are deleted at the end: for whoever runs many queries in one session and has taken a query's result before."""
    start = len(_written)
    try:
        yield
    finally:
        _drop(start)


def _drop(start: int) -> None:
    while len(_written) > start:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path).getParent()
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone at exit
            pass


def release() -> None:
    """Deletes every table written by cut(); frames read from them are void afterwards."""
    _drop(0)


atexit.register(release)
