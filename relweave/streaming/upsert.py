"""Structured Streaming forms: windowed counts with late data, and a keyed upsert. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relweave.operators.labels import latest


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and event type; works on batch and streaming frames alike."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    got = kept.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("w_start"), "event_type", "n", "total")


def upsert_stream(rows: DataFrame, spark: SparkSession, path: str, checkpoint: str, key: list[str], position: str) -> StreamingQuery:
    """Keeps the last row of each key: each batch is merged with the newest table under path and written beside it."""

    def merge(batch: DataFrame, epoch: int) -> None:
        old = f"{path}/v{epoch - 1}"
        own = latest(batch, key, position)
        if epoch:
            own = latest(spark.read.parquet(old).unionByName(own), key, position)
        own.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
