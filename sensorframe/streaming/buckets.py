"""Bucket counts over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_bucket_agg(stream: DataFrame, every: str, watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """Running count per bucket, for update mode.

    State is one counter per bucket. With a ``watermark`` old buckets are released, and rows later
    than it are dropped; leave it out where files may arrive in any order of time, as in a backfill.
    """
    if watermark:
        stream = stream.withWatermark(ts, watermark)
    return stream.groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("bucket"), "n")


def run_bucket_agg(buckets: DataFrame, updates: str, checkpoint: str) -> None:
    """Process what is available; every step appends its changed buckets, tagged with the step, to ``updates``."""

    def append(batch: DataFrame, batch_id: int) -> None:
        # a repeated step rewrites its own directory
        batch.write.mode("overwrite").parquet(f"{updates}/step={batch_id}")

    # an empty first step, so that a stream without any data still leaves a readable result
    empty = buckets.sparkSession.createDataFrame([], buckets.schema)
    empty.write.mode("overwrite").parquet(f"{updates}/step=-1")
    query = (
        buckets.writeStream.outputMode("update").foreachBatch(append)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_buckets(spark: SparkSession, updates: str) -> DataFrame:
    """``(bucket, n)``: the last value written for every bucket."""
    steps = spark.read.schema("bucket TIMESTAMP, n BIGINT, step BIGINT").parquet(updates)
    return steps.groupBy("bucket").agg(F.max_by("n", "step").alias("n"))
