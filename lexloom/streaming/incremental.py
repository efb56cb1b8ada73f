"""Incremental runs: only rows that a sink lacks, as a batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def append_missing(rows: DataFrame, path: str, key: str, step: Callable[[DataFrame], DataFrame]) -> int:
    """Runs ``step`` on rows whose key the parquet sink lacks and appends the result; returns the number of those rows."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    todo = rows.join(spark.read.parquet(path).select(key), key, "left_anti") if exists else rows
    n = todo.count()
    if n:
        step(todo).write.mode("append").parquet(path)
    return n


def run_available(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame]) -> None:
    """Processes all new files of a folder once; the checkpoint remembers what was done."""
    stream = step(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def distinct_within(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first row of each key while the watermark remembers it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
