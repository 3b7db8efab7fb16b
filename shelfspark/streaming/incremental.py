"""The same operators on streams: appends without repeats, windows, merges of micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once(stream: DataFrame, key: Sequence[str], at: str, late: str) -> DataFrame:
    """Each key once; a key is forgotten when ``late`` has passed."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(key))


def windowed(stream: DataFrame, at: str, late: str, size: str, *by: str) -> DataFrame:
    """Counts by window; rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def merged(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Fold each micro-batch into a table of versions: batch n is written beside n - 1, so that a repeated batch
    gives the same table and a reader sees whole ones; versions before n - 1 are removed. The table is written anew
    for each batch: plain files have no update in place, so let batches be large beside the table."""

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/{n - 1}") if n else None
        merge(old, batch).write.mode("overwrite").parquet(f"{path}/{n}")
        if n > 1:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n - 2}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
