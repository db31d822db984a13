"""Tables that an operator writes for itself, in the folder that all executors share; memory of its workers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where Spark runs in one process and names no folder.
LOCAL_ROOT = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{LOCAL_ROOT}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; it is removed when the application ends."""
    path = f"{shared_root(spark)}/wordtide/{uuid.uuid4().hex}/{label}"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: cuts lineage, survives lost executors, and is computed once."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hands freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` over batches; the worker, which Spark uses again, keeps none of the memory that it took."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run
