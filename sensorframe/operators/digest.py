"""Approximate percentiles from small mergeable summaries: a t-digest, and a repeatable sample."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.rank import top_rows_per_group
from sensorframe.session import ship_package

_CENTROIDS = "mean DOUBLE, weight BIGINT"

#: Values a task holds besides its centroids.
_BUFFER = 1 << 16


def compress(means: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most about ``size`` centroids of weighted values, small ones near both ends.

    Values in order are cut where the arc sine of their share of all rows passes a step, so a centroid's share is in
    proportion to sqrt(q * (1 - q)). The smallest and the largest value stay by themselves.
    """
    if not len(means):
        return means, weights
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    share = (np.cumsum(weights) - weights / 2) / weights.sum()
    step = np.floor(size / np.pi * (np.arcsin(np.clip(2 * share - 1, -1, 1)) + np.pi / 2))
    step[0], step[-1] = -1, size + 1
    opens = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
    total = np.add.reduceat(weights, opens)
    closes = np.append(opens[1:], len(means)) - 1
    with np.errstate(invalid="ignore", over="ignore"):
        middle = np.add.reduceat(means * (weights / np.repeat(total, closes - opens + 1)), opens)
    return np.clip(middle, means[opens], means[closes]), total


def quantile(means: np.ndarray, weights: np.ndarray, p: float) -> float | None:
    """The value at rank ``p * (n - 1)``, interpolated between the middles of centroids."""
    if not len(means):
        return None
    middles = np.cumsum(weights) - weights + (weights - 1) / 2
    return float(np.interp(p * (weights.sum() - 1), middles, means))


def _merged(rows: DataFrame, size: int) -> DataFrame:
    """The centroids of each task's centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [(np.zeros(0), np.zeros(0, np.int64))], 0
        for batch in batches:
            held.append((batch.column("mean").to_numpy(), batch.column("weight").to_numpy()))
            n += batch.num_rows
            if n > _BUFFER:
                held = [compress(*(np.concatenate(x) for x in zip(*held, strict=True)), size)]
                n = 0
        means, weights = compress(*(np.concatenate(x) for x in zip(*held, strict=True)), size)
        yield pa.RecordBatch.from_arrays([pa.array(means), pa.array(weights)], ["mean", "weight"])

    return rows.mapInArrow(run, _CENTROIDS)


def digest(df: DataFrame, column: str, size: int = 500, fan_in: int = 64) -> DataFrame:
    """``(mean, weight)``: the t-digest of a column, at most about ``size`` rows. Nulls and NaN are left out.

    Each task makes a digest of its rows; these are merged in ``fan_in`` groups and the groups' digests into one, so no task sees more than
    the digests of one group. Digests of parts of a table, unioned, are merged by ``merge_digests``.
    """
    ship_package(df.sparkSession)
    values = df.select(F.col(column).cast("double").alias("mean"), F.lit(1).cast("long").alias("weight"))
    return merge_digests(_merged(values.filter("mean IS NOT NULL AND NOT isnan(mean)"), size), size, fan_in)


def merge_digests(digests: DataFrame, size: int = 500, fan_in: int = 64) -> DataFrame:
    """One digest of a union of digests."""
    grouped = _merged(digests.repartition(fan_in), size)
    return _merged(grouped.repartition(1), size)


def digest_percentiles(df: DataFrame, column: str, probs: dict[str, float], size: int = 500) -> DataFrame:
    """One row: percentiles from a t-digest, most exact at the tails; null for a column without values.

    The rank error is at most about ``pi / size * sqrt(p * (1 - p))`` of all rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), schema=pa.schema([("mean", pa.float64()), ("weight", pa.int64())]))
        means, weights = (whole.column(c).to_numpy() for c in ("mean", "weight"))
        yield pa.RecordBatch.from_arrays([pa.array([quantile(means, weights, p)], pa.float64()) for p in probs.values()], list(probs))

    return digest(df, column, size).mapInArrow(run, ", ".join(f"`{name}` DOUBLE" for name in probs))


def sample(df: DataFrame, k: int, identity: Sequence[str], fan_in: int = 64) -> DataFrame:
    """The ``k`` rows whose hash of ``identity`` is smallest: a uniform sample, the same for any partitioning and order of the rows.

    ``identity`` should be unique, or equal rows are sampled together. Samples of parts of a table are merged by sampling
    their union. Each task keeps ``k`` rows, and so does each of ``fan_in`` groups of tasks before the last step.
    """
    hashed = df.withColumns({"_h": F.xxhash64(*identity), "_group": F.pmod(F.spark_partition_id(), F.lit(fan_in)), "_less": F.lit(0)})
    kept = top_rows_per_group(hashed, ["_group"], "_less", k, ["_h", *identity])
    return kept.orderBy("_h", *identity).limit(k).drop("_h", "_group", "_less")


def sampled_percentiles(df: DataFrame, column: str, probs: dict[str, float], identity: Sequence[str], k: int = 10_000) -> DataFrame:
    """One row: exact percentiles of a sample of ``k`` rows. With 99 % certainty the rank error is below ``1.63 / sqrt(k)`` of all rows."""
    few = sample(df.filter(F.col(column).isNotNull()).select(F.col(column).alias("_value"), *[c for c in identity]), k, identity)
    return few.agg(*[F.percentile(F.col("_value").cast("double"), F.lit(p)).alias(name) for name, p in probs.items()])
