"""Exact distinct counts over appends: one bitmap of dense key numbers per group and step, merged when asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.session import materialize
from sensorframe.sources.steps import append_step, is_finished, read_steps, write_step


def add_distinct(rows: DataFrame, folder: str, load: str, step: int, key: str = "user_id", group: str = "day") -> None:
    """Add the keys of each group of ``rows`` to the counts in ``folder``, as one step of a load (see ``write_step``).

    New keys get the next numbers of a dictionary. A bitmap holds 32,768 numbers in 4 KB, whatever the number of rows, and rows of
    earlier steps are not read again. Null keys are not counted; a null group is a group.
    """
    spark = rows.sparkSession
    if is_finished(spark, f"{folder}/bitmaps", load, step):
        return
    kind, in_group = rows.schema[key].dataType.simpleString(), F.col(group).alias("grp")
    pairs = materialize(rows.filter(F.col(key).isNotNull()).select(in_group, F.col(key).alias("key")).distinct(), "pairs")
    known = read_steps(spark, f"{folder}/keys", f"id BIGINT, key {kind}")
    fresh = pairs.select("key").distinct().join(known, "key", "left_anti")
    # numbered from what is written, because drawing positions again could draw them differently
    placed = materialize(fresh.withColumns({"chunk": F.lit(0), "pos": F.monotonically_increasing_id()}), "fresh")
    append_step(placed, f"{folder}/keys", load, step)
    numbered = pairs.join(read_steps(spark, f"{folder}/keys", f"id BIGINT, key {kind}"), "key")
    bits = numbered.groupBy("grp", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    write_step(bits, f"{folder}/bitmaps", load, step)


def distinct_counts(spark: SparkSession, folder: str, group_type: str, per_group: bool = True) -> DataFrame:
    """``(group, n)`` of every group, or ``(n)`` of all together: bitmaps merged and counted, no key is read."""
    keys = ["grp"] if per_group else []
    bits = read_steps(spark, f"{folder}/bitmaps", f"grp {group_type}, bucket BIGINT, bits BINARY")
    merged = bits.groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    total = merged.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return total.withColumnRenamed("grp", "group")
