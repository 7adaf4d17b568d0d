"""The event table: layouts, append, typed scan, and the column variants in use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions import SECOND_US, day_date, floor_to, no_zone
from sensorframe.operators.timeslice import part_hour
from sensorframe.schema import EVENT

_PARTITION_FIELDS = {
    "plain": [],
    "sorted": [],
    "time": [T.StructField("event_date", T.DateType()), T.StructField("part_hour", T.IntegerType())],
    "shards": [T.StructField("shard", T.IntegerType())],
}


def write_events(df: DataFrame, path: str, layout: str = "plain", mode: str = "append", shards: int = 4,
                 partitions: int | None = None) -> None:
    """Append events to the table at ``path``.

    - ``plain``: as they come.
    - ``time``: one directory per four hours, sorted by time inside the files.
    - ``shards``: one directory per hash shard of the timestamp.
    - ``sorted``: globally sorted by time, so files and row groups cover disjoint time ranges.
      ``partitions`` sets the number of files (default: the session's shuffle partitions).

    ``time`` and ``shards`` go through a rebalance: small groups share a task, and a group much
    larger than the rest (a busy hour, or any shard of a large table) is split over many.
    """
    if layout == "plain":
        df.write.mode(mode).parquet(path)
    elif layout == "time":
        out = df.withColumn("event_date", day_date("ts")).withColumn("part_hour", part_hour(F.col("ts")))
        out = out.hint("rebalance", "event_date", "part_hour").sortWithinPartitions("event_date", "part_hour", "ts")
        out.write.mode(mode).partitionBy("event_date", "part_hour").parquet(path)
    elif layout == "shards":
        out = df.withColumn("shard", F.pmod(F.hash("ts"), F.lit(shards))).hint("rebalance", "shard")
        out.write.mode(mode).partitionBy("shard").parquet(path)
    elif layout == "sorted":
        # the id spreads the rows of one crowded instant over several ranges
        order = ["ts", "id"] if "id" in df.columns else ["ts", "user_id", "ssid"]
        out = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
        out.sortWithinPartitions(*order).write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown layout {layout!r}")


def read_events(spark: SparkSession, path: str, layout: str = "plain", schema: T.StructType = EVENT) -> DataFrame:
    """Scan an event table with its declared schema and the partition columns of its layout."""
    return spark.read.schema(T.StructType(schema.fields + _PARTITION_FIELDS[layout])).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, key: str = "user_id", buckets: int = 64) -> DataFrame:
    """Write the table ``name``, kept at ``path``, in ``buckets`` by the hash of ``key``, and give it back.

    Grouping by ``key``, and joins of two such tables on it, need no shuffle. A bucket is read by one task at a time, so their number is
    that of the tasks wanted later; a key with very many rows makes its bucket large, which suits aggregates but not sorts of it.
    """
    # all rows of a bucket come from one task, so that it is one file
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def as_variant(events: DataFrame, variant: str) -> DataFrame:
    """The event table in one of the column variants in use.

    - ``no_zone``: no id, timestamp without time zone.
    - ``whole_seconds``: timestamp cut to seconds.
    - ``wide_signal``: no id, signal strength as float64.
    """
    if variant == "no_zone":
        return events.select("user_id", no_zone("ts").alias("ts"), "rssi", "ssid")
    if variant == "whole_seconds":
        return events.select("id", "user_id", floor_to("ts", SECOND_US).alias("ts"), "rssi", "ssid")
    if variant == "wide_signal":
        return events.select("user_id", "ts", F.col("rssi").cast("double").alias("rssi"), "ssid")
    raise ValueError(f"unknown variant {variant!r}")
