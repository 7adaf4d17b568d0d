"""Summaries for percentiles: rank errors, tails, merging, and the same result for any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.operators import digest, digest_percentiles, merge_digests, sample, sampled_percentiles, sketch_percentiles
from sensorframe.operators.digest import compress, quantile

PROBS = {"low": 0.001, "mid": 0.5, "high": 0.999}


@pytest.fixture(scope="module")
def skewed(spark):
    """A million values over ten orders of magnitude, of both signs, in no order."""
    return spark.range(1_000_000, numPartitions=24).selectExpr("id", "sinh((((id * 7919) % 1000003) / 1000003D - 0.5D) * 40) AS v").cache()


def rank_errors(df, found):
    row = df.agg(*[(F.count_if(F.col("v") <= v) / F.count("v")).alias(n) for n, v in found.asDict().items()]).first()
    return {n: abs(row[n] - PROBS[n]) for n in PROBS}


def test_digest_keeps_its_rank_error_and_the_tails(spark, skewed):
    own = rank_errors(skewed, digest_percentiles(skewed, "v", PROBS, size=200).first())
    assert own["mid"] < 0.5 * np.pi / 200 and own["low"] < 0.0005 and own["high"] < 0.0005
    kll = rank_errors(skewed, sketch_percentiles(skewed, "v", PROBS, k=200).first())
    assert own["low"] <= kll["low"] and own["high"] <= kll["high"] and own["low"] + own["high"] < 0.5 * (kll["low"] + kll["high"]) + 1e-6


def test_digest_is_small_and_whole(spark, skewed):
    rows = digest(skewed, "v", size=200).collect()
    edges = skewed.agg(F.min("v"), F.max("v")).first()
    assert len(rows) <= 203 and sum(r.weight for r in rows) == 1_000_000
    assert min(r.mean for r in rows) == edges[0] and max(r.mean for r in rows) == edges[1]


def test_digests_of_parts_merge(spark, skewed):
    parts = [digest(skewed.where(F.col("id") % 3 == k), "v") for k in range(3)]
    rows = merge_digests(parts[0].union(parts[1]).union(parts[2])).toPandas().sort_values("mean")
    found = {n: quantile(rows["mean"].to_numpy(), rows["weight"].to_numpy(), p) for n, p in PROBS.items()}
    row = skewed.agg(*[(F.count_if(F.col("v") <= v) / F.count("v")).alias(n) for n, v in found.items()]).first()
    assert all(abs(row[n] - p) < 0.003 for n, p in PROBS.items())


@pytest.mark.parametrize("values, want", [([], None), ([None, float("nan")], None), ([3.0], 3.0), ([1.0, 2.0], 1.5), ([7.0] * 1000, 7.0), ([-1e300, 0.0, 1e300], 0.0)])
def test_digest_of_few_values_is_exact(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert digest_percentiles(df, "v", {"mid": 0.5}).first().mid == want


def test_compress_keeps_order_and_weight():
    rng = np.random.default_rng(0)
    means, weights = compress(rng.standard_normal(10_000), rng.integers(1, 9, 10_000), 100)
    assert len(means) <= 103 and (np.diff(means) >= 0).all()
    assert compress(means, weights, 100)[1].sum() == weights.sum()


def test_sample_is_the_same_for_any_partitioning(spark, skewed):
    few = sample(skewed, 500, ["id"])
    ids = sorted(r.id for r in few.collect())
    assert len(set(ids)) == 500 and ids == sorted(r.id for r in sample(skewed.repartition(5).orderBy("v"), 500, ["id"], fan_in=3).collect())
    halves = sample(skewed.where("v < 0"), 500, ["id"]).union(sample(skewed.where("v >= 0"), 500, ["id"]))
    assert ids == sorted(r.id for r in sample(halves, 500, ["id"]).collect())
    assert sample(skewed.where("id < 3"), 500, ["id"]).count() == 3 and few.columns == skewed.columns


def test_sampled_percentiles_keep_their_rank_error(spark, skewed):
    errors = rank_errors(skewed, sampled_percentiles(skewed, "v", PROBS, ["id"], 4000).first())
    assert max(errors.values()) < 1.63 / np.sqrt(4000)
    assert sampled_percentiles(skewed.where("id < 0"), "v", PROBS, ["id"]).first().mid is None
