"""Gap filling on a stream: every series gives out its empty buckets as time passes them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sensorframe.functions import SECOND_US
from sensorframe.session import ship_package
from sensorframe.streaming.upserts import STORE


class EmptyBuckets(StatefulProcessor):
    """Passes the closed buckets of a series on in order, with those between them, and wakes up for those that nothing closes.

    State is one number per series, the start of the next bucket to give out, and one timer at that bucket's end.
    """

    def __init__(self, keys: Sequence[str], step_us: int, first_us: int, stop_us: int | None):
        self.keys, self.step_us, self.first_us, self.stop_us = list(keys), step_us, first_us, stop_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "at LONG")

    def _rows(self, key, at: int, to: int) -> Iterator[Row]:
        for bucket in range(at, to, self.step_us):
            yield Row(**dict(zip(self.keys, key, strict=True)), bucket=bucket, n=0)

    def _pass(self, key, at: int, timerValues) -> Iterator[Row]:
        """The empty buckets that the watermark has passed, then a timer for the next one, if there is one."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // self.step_us * self.step_us
        if self.stop_us is not None:
            passed = min(passed, -(-self.stop_us // self.step_us) * self.step_us)
        yield from self._rows(key, at, passed)
        at = max(at, passed)
        if self.stop_us is not None and at >= self.stop_us:
            self.next.clear()
            return
        self.next.update((at,))
        self.handle.registerTimer(-(-(at + self.step_us) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at = self.next.get()[0] if self.next.exists() else self.first_us
        for bucket, n in sorted((row["bucket"], row["n"]) for row in rows):
            yield from self._rows(key, at, bucket)
            yield Row(**dict(zip(self.keys, key, strict=True)), bucket=bucket, n=n)
            at = bucket + self.step_us
        yield from self._pass(key, at, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.next.exists():
            yield from self._pass(key, self.next.get()[0], timerValues)

    def close(self) -> None:
        pass


def stream_gap_fill(stream: DataFrame, every_seconds: int, lo: Column, hi: Column | None, keys: Sequence[str],
                    watermark: str, ts: str = "ts") -> DataFrame:
    """``keys, bucket, bucket_end, n``: rows per bucket of ``[lo, hi)`` for every series seen in it, empty buckets included; for append mode.

    A bucket appears once the watermark has passed its end, whether the series had rows in it or not, so a series that falls silent
    goes on. ``lo`` and ``hi`` are literals, null for an empty range; ``hi`` may be None for no end; ``bucket_end`` is cut off at it. Rows that come later than the watermark, and those
    without a time, are dropped. Counts are built natively, combined before the shuffle, so a series with a third of all rows
    reaches its state as one row a bucket; Python sees closed buckets only. Buckets are aligned to the epoch.
    """
    step_us = every_seconds * SECOND_US
    lo_us, hi_us = stream.sparkSession.range(1).select(F.unix_micros(lo), F.lit(None) if hi is None else F.unix_micros(hi)).first()
    if lo_us is None:
        lo_us = hi_us = 0
    micros = F.unix_micros(ts)
    inside = micros >= lo_us if hi_us is None else (micros >= lo_us) & (micros < hi_us)
    counted = (
        stream.filter(F.col(ts).isNotNull()).withWatermark(ts, watermark).filter(inside)
        .groupBy(*keys, F.window(ts, f"{every_seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
        .select(*keys, F.window_time("w").alias("closed"), F.unix_micros("w.start").alias("bucket"), "n")
    )
    fields = [T.StructField(k, stream.schema[k].dataType) for k in keys]
    out = T.StructType([*fields, T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    processor = EmptyBuckets(keys, step_us, lo_us // step_us * step_us, hi_us)
    filled = counted.groupBy(*keys).transformWithState(processor, out, "Append", "EventTime")
    end = F.col("bucket") + step_us
    return filled.select(
        *keys, F.timestamp_micros("bucket").alias("bucket"), F.timestamp_micros(end if hi_us is None else F.least(end, F.lit(hi_us))).alias("bucket_end"), "n")


@contextmanager
def _keyed_state(spark: SparkSession):
    """The settings that a query with timers is started with; afterwards the session's own are back."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def append_available(filled: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is available, append the buckets that are complete to the table at ``path``, and read all of it.

    A step that is repeated after a crash adds nothing twice: the sink's log names the files that count.
    """
    spark = ship_package(filled.sparkSession)
    with _keyed_state(spark):
        query = filled.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(filled.schema).parquet(path)
