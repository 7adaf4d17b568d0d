"""Tagged points: the long form of an event, and last-write-wins upserts, of a DataFrame and into a stored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.session import move_path, path_exists, remove_path

MEASUREMENT = "user_events"


def to_points(events: DataFrame, fields: Sequence[str] = ("rssi",), measurement: str = MEASUREMENT) -> DataFrame:
    """One row per event and field: ``measurement, user_id, ssid, field, value, time``."""
    pairs = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in fields)
    return events.selectExpr(
        f"'{measurement}' AS measurement", "user_id", "ssid",
        f"stack({len(fields)}, {pairs}) AS (field, value)", "ts AS time")


def upsert_points(events: DataFrame, keys: Sequence[str] = ("user_id", "ssid", "ts"), version: str = "id") -> DataFrame:
    """Keep the row with the highest ``version`` among rows of the same series and time.

    A null version is the lowest. Of equal versions one whole row is kept, always the same. An aggregate rather
    than a ranking window: copies are already reduced to one row per task before the shuffle, so a key
    with very many copies stays cheap.
    """
    rest = [c for c in events.columns if c not in (*keys, version)]
    # version and a hash of the row in one number, which a hash aggregate can keep in place
    number = F.coalesce(F.col(version), F.lit(-(2**63))).cast("decimal(38,0)") * F.lit(2**32).cast("decimal(11,0)")
    order = number + F.hash(*(rest or keys)).cast("decimal(11,0)")
    ranked = events.withColumn("_order", order.cast("decimal(38,0)"))
    last = ranked.groupBy(*keys).agg(
        F.max(version).alias(version),
        *[F.max_by(c, "_order").alias(c) for c in rest],
    )
    return last.select(*events.columns)


def _finish_swap(spark: SparkSession, path: str, partition: str) -> None:
    """Put the merged partitions in the place of the old ones, also those that an earlier call left behind."""
    merged = f"{path}/_merged"
    if path_exists(spark, merged):
        spark.read.parquet(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        remove_path(spark, merged)


def upsert_stored(batch: DataFrame, path: str, keys: Sequence[str], version: str = "id", partition: str = "day") -> int:
    """Merge ``batch`` into the table at ``path`` by ``upsert_points``; the number of partitions written.

    The table has a folder for each value of the key column ``partition``. Only folders that the batch has rows of are read
    and replaced, all other files stay as they are. Merged partitions are complete in a folder of their own before the first old one
    goes, and a call that broke off while replacing is finished by the next one. A repeated batch changes nothing.
    """
    if partition not in keys:
        raise ValueError(f"{partition!r} must be one of the keys, or equal points would lie in several partitions")
    spark, path = batch.sparkSession, path.rstrip("/")
    _finish_swap(spark, path, partition)
    # one value for each folder to write, as many as the writer has folders
    touched = [r[0] for r in batch.select(partition).distinct().collect()]
    if not touched:
        return 0
    both = batch
    if path_exists(spark, path):
        stored = spark.read.schema(batch.schema).parquet(path)
        within = F.col(partition).isin([v for v in touched if v is not None])
        both = stored.filter(within | F.col(partition).isNull() if None in touched else within).unionByName(batch)
    started = f"{path}/_merging"
    upsert_points(both, keys, version).write.mode("overwrite").parquet(started)
    move_path(spark, started, f"{path}/_merged")
    _finish_swap(spark, path, partition)
    return len(touched)
