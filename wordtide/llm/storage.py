"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.sources.shared import fresh_path
from wordtide.sources.shared import give_back as give_back
from wordtide.sources.shared import trimmed as trimmed

def drop(spark: SparkSession, path: str) -> None:
    """Remove a table that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def save(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    return save(df, label)[0]


def settle(df: DataFrame, label: str) -> DataFrame:
    """``materialise``, after which Spark deletes the shuffle files of the step at once (``clear`` waits for a collection of garbage)."""
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        return materialise(df, label)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def clear(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of finished steps: it does when the driver collects the plans that made them, which else may be late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def packed(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with the needed columns and all others in one, ``extra``, so that none of their names can clash with an operator's own; and
    a function that gives a result its columns back, in their order, followed by columns that were added (these replace any of their name)."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    extra = [c for c in docs.columns if c not in needed]
    safe = docs.select(*needed, F.struct(*map(quoted, extra)).alias("extra")) if extra else docs.select(*needed)

    def restore(out: DataFrame, *added: str) -> DataFrame:
        of = [F.col(c) if c in needed else F.col("extra").getField(c).alias(c) for c in docs.columns if c not in added]
        return out.select(*of, *added)

    return safe, restore
