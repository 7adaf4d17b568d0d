"""Stored hourly moments of the event table, refreshed where its files have changed and merged to any coarser group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.operators.buckets import bucket_agg
from sensorframe.session import path_exists, remove_path
from sensorframe.sources.events import read_events

ROLLUP = "hour TIMESTAMP, n BIGINT, mean DOUBLE, m2 DOUBLE, stamp BIGINT, event_date DATE"


def moments(column: str) -> list[Column]:
    """``n, mean, m2``: number of values, their mean, and the sum of squared distances from it."""
    return [F.count(column).alias("n"), F.avg(column).alias("mean"), (F.var_pop(column) * F.count(column)).alias("m2")]


def merge_moments(rows: DataFrame, keys: Sequence[str | Column], order: str) -> DataFrame:
    """``(*keys, n, mean, m2)``: moments of groups of rows that have moments, added one after the other in ``order``.

    Exact up to rounding: no squares of large means are subtracted from each other, as sums of squares would. A group's
    rows are put in one row, so it holds buckets of a bounded range, a day's hours or a year's, not events.
    """
    part = F.sort_array(F.collect_list(F.struct(order, "n", "mean", "m2")))

    def add(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.when(b["n"] == 0, a).when(a["n"] == 0, F.struct(b["n"].alias("n"), b["mean"].alias("mean"), b["m2"].alias("m2"))).otherwise(
            F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2")))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("m2"))
    merged = rows.groupBy(*keys).agg(F.aggregate(part, start, add).alias("all"))
    names = [k if isinstance(k, str) else merged.columns[i] for i, k in enumerate(keys)]
    return merged.select(*names, "all.n", "all.mean", "all.m2")


def variance(n: str = "n", m2: str = "m2", sample: bool = True) -> Column:
    """Variance from moments; null where there are too few values."""
    less = 1 if sample else 0
    return F.when(F.col(n) > less, F.col(m2) / (F.col(n) - less))


def _stamps(spark: SparkSession, path: str) -> DataFrame:
    """``(event_date, stamp)``: a number that differs once a day's files have changed; files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    day = F.regexp_extract("path", "event_date=([0-9-]+)/", 1).try_cast("date").alias("event_date")
    listed = files.select(day, F.xxhash64("path", "length", "modificationTime").alias("h")).filter("event_date IS NOT NULL")
    return listed.groupBy("event_date").agg(F.bit_xor("h").alias("stamp"))


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """``(hour, n, mean, m2, stamp, event_date)`` of the refreshed hours."""
    return spark.read.schema(ROLLUP).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], ROLLUP)


def refresh_rollup(spark: SparkSession, events: str, path: str, column: str = "rssi") -> list:
    """Bring the hourly moments at ``path`` up to date with the event table ``events`` in the ``time`` layout; the days done.

    A day is computed again if its files are others than those it was computed from, and only its files are read. Each day's rows
    keep the stamp of these files, so a refresh that broke off leaves some days to the next one and none half done. Days
    that the event table no longer has are removed. Values that are null are not counted.
    """
    now = _stamps(spark, events)
    had = read_rollup(spark, path).groupBy("event_date").agg(F.max("stamp").alias("had"))
    differs = now.join(had, "event_date", "full").filter("NOT (stamp <=> had)")
    # one row for each day to compute, at most as many as there are folders
    days = {r["event_date"]: r["stamp"] for r in differs.collect()}
    for day in (d for d, stamp in days.items() if stamp is None):
        remove_path(spark, f"{path.rstrip('/')}/event_date={day}")
    some = sorted(d for d, stamp in days.items() if stamp is not None)
    if some:
        changed = read_events(spark, events, "time").filter(F.col("event_date").isin(some))
        hourly = bucket_agg(changed, "1 hour", moments(column), ["event_date"], name="hour")
        stamped = hourly.join(now.filter(F.col("event_date").isin(some)), "event_date")
        stamped.select("hour", "n", "mean", "m2", "stamp", "event_date").hint("rebalance", "event_date").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    return sorted(days)


def hourly_counts(rollup: DataFrame) -> DataFrame:
    """``(bucket, n)`` for ``hour_of_day_from_buckets`` and top-k."""
    return rollup.select(F.col("hour").alias("bucket"), "n")
