"""A bounded, repeatable sample of labelled documents to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Every fifth id by CRC-32: rows that no model learns from. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def class_sizes(labels: DataFrame, label: str) -> dict[int, int]:
    """Rows of each class among those that models may learn from."""
    rows = (
        labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
        .groupBy(F.col(label).cast("int").alias("y")).count().collect()
    )
    return {r["y"]: r["count"] for r in rows}


def sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``per_class`` labelled rows a class, those with the smallest hash of the id.

    A label that isn't 0 or 1 is left out. Of several labels of one id the smallest counts.
    """
    known = (
        labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 0").orderBy(*order).limit(per_class).union(
        known.where("y = 1").orderBy(*order).limit(per_class)
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
