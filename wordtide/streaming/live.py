"""The corpus as a stream: first versions within a watermark, counted per window.

``window_counts`` is the stateful form: Spark's state store keeps the keys and the open windows, a window is given out once, when the
watermark has passed its end, and rows behind the watermark are dropped and counted by Spark (``dropped``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counts(stream: DataFrame, at: str, key: str, width: str = "1 day", late: str = "1 hour", *groups: str) -> DataFrame:
    """Distinct keys per time window; rows later than ``late`` are left out. Works on batch frames alike."""
    unique = stream.withWatermark(at, late)
    unique = unique.dropDuplicatesWithinWatermark([key]) if stream.isStreaming else unique.dropDuplicates([key])
    return unique.groupBy(F.window(at, width).alias("w"), *groups).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *groups, "n")


def first_versions(stream: DataFrame, at: str, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key: what a later row repeats within the watermark does not come through again."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_now(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes in what there is, appends the results to Parquet and ends; the checkpoint lets a later run go on from there."""
    query = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def counts_from_stream(spark: SparkSession, source: str, schema: str, root: str, at: str, key: str, width: str, *groups: str, late: str = "1 hour") -> DataFrame:
    """``counts`` of Parquet files that are read as a stream: first versions are stored as they come, windows are counted over what is stored."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream = stream.withColumn(at, F.col(at).cast("timestamp"))
    run_now(first_versions(stream, at, key, late), f"{root}/first", f"{root}/checkpoint")
    stored = spark.read.schema(stream.schema).parquet(f"{root}/first")
    return stored.groupBy(F.window(at, width).alias("w"), *groups).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *groups, "n")


def window_counts(stream: DataFrame, at: str, key: str, width: str, late: str, *groups: str) -> DataFrame:
    """Distinct keys per closed time window and group, in append mode. A row not after the watermark is dropped before it reaches a window; the
    watermark trails the latest row of the batches before by ``late``. Rows of equal key within the watermark count once."""
    return first_versions(stream, at, key, late).groupBy(F.window(at, width).alias("w"), *groups).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *groups, "n")


def dropped(query: StreamingQuery) -> int:
    """Rows that the query's first stateful operator has dropped for being late, by the progress that Spark keeps (see
    ``spark.sql.streaming.numRecentProgressUpdates``)."""
    return sum(p["stateOperators"][-1]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])


def take_in(spark: SparkSession, source: str, schema: str, root: str, at: str, key: str, width: str, late: str, *groups: str) -> int:
    """One run of ``window_counts`` over the Parquet files that have come to ``source`` since the last: closed windows are appended under
    ``root``/windows, state and offsets go on from ``root``/checkpoint. The number of late rows that it dropped."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream = stream.withColumn(at, F.col(at).cast("timestamp"))
    return dropped(run_now(window_counts(stream, at, key, width, late, *groups), f"{root}/windows", f"{root}/checkpoint"))
