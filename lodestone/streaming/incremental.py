"""Incremental indexing as a stream: batches of changed files keep an index up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalars import hash16


def follow(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str, extract):
    """Start a query that reads new Parquet files of (path, content, version) rows and appends extract(changed) to the index with path, hash and version.

    Rows of an index are versions; `latest` reads the current ones. A batch that comes again after a failure is written to the same place, so nothing doubles."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version"))
        rows = extract(newest).join(newest.select("path", "version", hash16(F.col("content")).alias("hash")), "path")
        rows.write.mode("overwrite").parquet(f"{index}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(index: DataFrame) -> DataFrame:
    """The rows of each path's newest version."""
    newest = index.groupBy("path").agg(F.max("version").alias("version"))
    return index.join(newest, ["path", "version"], "left_semi")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n, value) of a stream of events (ts, event_type, value); late rows are dropped beyond the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
