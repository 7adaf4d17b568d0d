"""Top-k, over the whole table and per group. Ties are always broken, so results are repeatable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, by: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by``; each task keeps only its own best ``k``."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def top_k(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], by: str, k: int) -> DataFrame:
    """Group by ``keys``, aggregate, and keep the ``k`` groups with the largest aggregate ``by``."""
    return top_rows(df.groupBy(*keys).agg(*aggs), by, k, keys)


def top_rows_per_group(df: DataFrame, group: Sequence[str], by: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by`` in every group.

    The rank filter lets Spark cut each task's rows to ``k`` per group before the shuffle, so a hot
    group arrives already reduced.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(by), *ties))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def top_k_per_group(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """``(group, item, n)``: the ``k`` most frequent items of every group."""
    counts = df.groupBy(group, item).agg(F.count("*").alias("n"))
    return top_rows_per_group(counts, [group], "n", k, [item])
