"""Calendar buckets, with and without gap filling, and hour-of-day profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.functions import DAY_US, HOUR_US, SECOND_US, day_date, floor_to, hour_of

_UNIT_US = {"second": SECOND_US, "minute": 60 * SECOND_US, "hour": HOUR_US, "day": DAY_US}


def bucket_of(every: str, ts: Column | str = "ts") -> Column:
    """Start of the bucket of width ``every``, e.g. ``15 minutes``, that a timestamp falls in.

    Buckets are aligned to the calendar: one hour starts on the hour, one day at midnight UTC.
    """
    n, unit = every.split()
    return floor_to(ts, int(n) * _UNIT_US[unit.rstrip("s")])


def bucket_agg(df: DataFrame, every: str, aggs: Sequence[Column], keys: Sequence[str] = (),
               name: str = "bucket", as_date: bool = False, ts: str = "ts") -> DataFrame:
    """Aggregate per bucket, and per ``keys`` if given; buckets without rows do not appear.

    ``every`` is an interval such as ``1 hour``, or ``inf`` for one bucket over everything. ``as_date``
    labels daily buckets with dates.
    """
    if every == "inf":
        return df.groupBy(*keys).agg(*aggs)
    bucket = day_date(ts) if as_date else bucket_of(every, ts)
    return df.groupBy(*keys, bucket.alias(name)).agg(*aggs)


def gap_fill(buckets: DataFrame, every: str, lo: Column, hi: Column, values: dict[str, object],
             keys: Sequence[str] = (), name: str = "bucket") -> DataFrame:
    """Add the empty buckets of ``[lo, hi)`` for every key combination that occurs.

    ``values`` gives the value of each aggregate in an empty bucket. Each bucket row emits itself
    and the gap up to the next one (the first also the gap after ``lo``), so the missing rows are
    generated in place: one shuffle of the already aggregated rows and no join. A group holds at
    most one row per bucket of the range. ``bucket_end`` is the bucket's end, cut off at ``hi``.
    """
    step = F.expr(f"INTERVAL {every}")
    order = Window.partitionBy(*keys).orderBy(name)
    first, last = bucket_of(every, lo), bucket_of(every, hi - F.expr("INTERVAL 1 MICROSECOND"))
    start = F.when(F.lag(name).over(order).isNull(), first).otherwise(F.col(name))
    stop = F.coalesce(F.lead(name).over(order) - step, last)
    filled = (
        buckets.withColumn("_start", start).withColumn("_stop", stop)
        .withColumn("_at", F.explode(F.sequence("_start", "_stop", step)))
    )
    here = F.col("_at") == F.col(name)
    return filled.select(
        *keys,
        F.col("_at").alias(name),
        F.least(F.col("_at") + step, hi).alias("bucket_end"),
        *[F.when(here, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in values.items()],
    )


def hour_of_day(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``(hour, n)``: rows per hour of the day."""
    return df.groupBy(hour_of(ts).alias("hour")).agg(F.count("*").alias("n"))


def hour_of_day_from_buckets(buckets: DataFrame, bucket: str = "bucket", n: str = "n") -> DataFrame:
    """The same profile summed from hourly counts that were computed before."""
    return buckets.groupBy(hour_of(bucket).alias("hour")).agg(F.sum(n).alias("n"))
