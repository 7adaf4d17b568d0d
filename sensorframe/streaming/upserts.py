"""Last-write-wins upserts over a stream: the newest version of every point as keyed state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorframe.session import remove_path, scratch_dir
from sensorframe.sources.points import upsert_stored

#: Keyed state with timers needs this store; a state of many points lies outside the JVM's heap in it.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _text(column: str, kind: str) -> Column:
    """A value as text, strings in quotes, to order rows of equal versions by."""
    value = F.col(f"`{column}`")
    shown = F.concat(F.lit("'"), value, F.lit("'")) if kind == "string" else value.cast("double" if kind == "float" else kind).cast("string")
    return F.coalesce(shown, F.lit("None"))


def newest_points(stream: DataFrame, keys: Sequence[str], time: str, version: str, lateness_seconds: int) -> DataFrame:
    """The newest version so far of each point that a step has rows of; for update mode.

    ``keys`` name a point and include its event time ``time``. A missing version is the lowest; of equal versions one whole row is kept,
    always the same. An aggregate, so that a task reduces its rows of a point to one before the shuffle and the state. Points up to
    ``lateness_seconds`` older than the latest one seen are taken in any order, older ones are dropped; state is one row a point within
    that time. Rows without a time are dropped.
    """
    rest = [(c, kind) for c, kind in stream.dtypes if c not in (*keys, version)]
    late = stream.filter(f"`{time}` IS NOT NULL").withWatermark(time, f"{lateness_seconds} seconds")
    order = F.struct(F.col(f"`{version}`"), F.concat_ws(", ", *[_text(*c) for c in rest]))
    values = F.struct(F.col(f"`{version}`"), *[F.col(f"`{c}`") for c, _ in rest])
    newest = late.groupBy(*keys).agg(F.max_by(values, order).alias("_newest"))
    return newest.select(*[F.col(f"`{c}`" if c in keys else f"_newest.`{c}`") for c in stream.columns])


def upsert_available(stream: DataFrame, path: str, keys: Sequence[str], time: str, version: str, partition: str,
                     lateness_seconds: int, checkpoint: str) -> StreamingQuery:
    """Merge what has arrived since the last call into the table at ``path`` (see ``upsert_stored``), then stop.

    A version that is older than one already seen reaches no file; its partition is written again as it was. Any order of arrival within the lateness leaves the same table, and so
    does a step that is repeated after a crash. ``partition`` must be computed from ``time`` and be one of the keys.
    """
    def step(batch: DataFrame, _: int) -> None:
        newest_path = scratch_dir(spark, "newest")
        batch.write.parquet(newest_path)  # the state is gone through once
        upsert_stored(spark.read.schema(batch.schema).parquet(newest_path), path, keys, version, partition)
        remove_path(spark, newest_path)

    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    newest = newest_points(stream, keys, time, version, lateness_seconds)
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        return (
            newest.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(step).trigger(availableNow=True).start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
