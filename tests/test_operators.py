import datetime as dt
import random
import statistics

import numpy as np
import pytest
from conftest import at
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorframe.functions import humanize_ms, n_rows, rfc3339
from sensorframe.operators import stats
from sensorframe.operators import (
    binned_percentiles, bucket_agg, exact_percentiles, gap_fill, hour_of_day, hour_of_day_from_buckets, implicit_group,
    percentiles, relative_slice, sketch_percentiles, time_slice, top_k_per_group, with_dense_id,
)

PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0, "p90": 0.9}


def numbers(spark, values, kind="float"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-(2.0**100), 2.0**100, width=32), min_size=1, max_size=60))
def test_exact_percentiles_match_numpy(spark, values):
    got = exact_percentiles(numbers(spark, values), "x", PROBS).first()
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.quantile(np.array(values, dtype="float64"), p), rel=1e-9, abs=1e-30)


def test_exact_percentiles_with_one_hot_value(spark):
    values = [-60.0] * 5000 + [-70.25, 0.0, -0.0, 12.5]
    got = exact_percentiles(numbers(spark, values), "x", PROBS).first()
    assert (got["q1"], got["median"], got["q3"], got["low"], got["high"]) == (-60.0, -60.0, -60.0, -70.25, 12.5)


def test_exact_percentiles_ignore_nulls_and_sort_nan_last(spark):
    values = numbers(spark, [1.0, None, 3.0, float("nan"), float("inf")])
    got = exact_percentiles(values, "x", {"a": 0.0, "b": 1 / 3, "c": 2 / 3, "d": 1.0}).first()
    assert (got["a"], got["b"], got["c"]) == (1.0, 3.0, float("inf"))
    assert got["d"] != got["d"]


def test_exact_percentiles_per_key(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([-5.0, 2.0]) * rng.random()) for k in ("a", "b", "c") for _ in range(rng.randint(1, 200))]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r["m"] for r in exact_percentiles(df, "x", {"m": 0.5}, ["k"]).collect()}
    for k in got:
        assert got[k] == pytest.approx(statistics.median(x for key, x in rows if key == k))


def test_percentiles_keep_the_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", 2.0)], "k string, x double")
    for method in ("exact", "binned"):
        got = {r["k"]: r["m"] for r in percentiles(df, "x", {"m": 0.5}, method, ["k"]).collect()}
        assert set(got) == {None, "a"}
    assert {r["k"]: r["m"] for r in percentiles(df, "x", {"m": 0.5}, keys=["k"]).collect()} == {None: 2.5, "a": 2.0}


def test_binned_percentiles_stay_within_their_error(spark):
    values = [-20 - 300 * random.Random(i).random() for i in range(5000)]
    got = binned_percentiles(numbers(spark, values, "double"), "x", PROBS).first()
    for name, p in PROBS.items():
        exact = sorted(values)[int(p * (len(values) - 1))]
        assert abs(got[name] / exact - 1) <= 0.0008


def test_sketch_percentiles_stay_within_their_rank_error(spark):
    n = 200_000
    df = spark.range(0, n, 1, 16).select(((F.col("id") * 7919) % n).cast("double").alias("x"))
    got = sketch_percentiles(df, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}).first()
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs(got[name] / n - p) <= 0.005


def test_unknown_percentile_method(spark):
    with pytest.raises(ValueError):
        percentiles(numbers(spark, [1.0]), "x", PROBS, "nearest")


def test_half_open_and_open_bounds(make_events):
    ue = make_events([("a", s, -60.0, "x") for s in (0, 10, 20)])
    lo, hi = F.lit(at(0)), F.lit(at(20))
    assert [time_slice(ue, lo, hi, c).count() for c in ("both", "left", "none")] == [3, 2, 1]
    with pytest.raises(ValueError):
        time_slice(ue, lo, hi, "right")


def test_relative_slice(make_events):
    ue = make_events([("a", s, -60.0, "x") for s in (0, 86400, 2 * 86400, 3 * 86400)])
    assert relative_slice(ue, "2 days", F.lit(at(3 * 86400))).count() == 2
    assert relative_slice(ue, "30 years", F.lit(at(4 * 86400))).count() == 4
    assert relative_slice(ue, "1 day").count() == 1


def test_buckets_skip_gaps_and_gap_fill_adds_them(make_events):
    ue = make_events([("a", h * 3600 + 5, -60.0, "x") for h in (0, 1, 5)] + [("b", 2 * 3600, -60.0, "y")])
    hourly = bucket_agg(ue, "1 hour", [n_rows()], ["user_id"])
    assert hourly.filter("user_id = 'a'").count() == 3
    filled = gap_fill(hourly, "1 hour", F.lit(at(0)), F.lit(at(5 * 3600 + 1800)), {"n": 0}, ["user_id"])
    rows = sorted((r["user_id"], r["bucket"], r["bucket_end"], r["n"]) for r in filled.collect())
    a = [r[1:] for r in rows if r[0] == "a"]
    assert [r[0] for r in a] == [at(h * 3600) for h in range(6)]
    assert [r[2] for r in a] == [1, 1, 0, 0, 0, 1]
    assert a[-1][1] == at(5 * 3600 + 1800), "the last bucket ends with the range"
    assert [r[3] for r in rows if r[0] == "b"] == [0, 0, 1, 0, 0, 0]


def test_gap_fill_without_keys(make_events):
    ue = make_events([("a", 0, -60.0, "x"), ("a", 3 * 86400, -60.0, "x")])
    daily = bucket_agg(ue, "1 day", [n_rows()])
    filled = gap_fill(daily, "1 day", F.lit(at(0)), F.lit(at(4 * 86400)), {"n": 0})
    assert [r["n"] for r in filled.orderBy("bucket").collect()] == [1, 0, 0, 1]


@pytest.mark.parametrize("every, unit", [("1 hour", "hour"), ("1 day", "day"), ("1 minute", "minute")])
def test_buckets_equal_date_trunc(spark, every, unit):
    df = spark.range(500).select(F.timestamp_micros(F.col("id") * 7_123_456_789_012 - 10**15).alias("ts"))
    wrong = df.groupBy("ts").agg(n_rows()).select("ts").join(
        bucket_agg(df, every, [n_rows()], ["ts"]), "ts").filter(F.col("bucket") != F.date_trunc(unit, "ts"))
    assert wrong.count() == 0


def test_hour_of_day_before_the_epoch(spark):
    df = spark.range(200).select(F.timestamp_micros(F.col("id") * 3_599_000_000 - 10**15).alias("ts"))
    expected = {r[0]: r[1] for r in df.groupBy(F.hour("ts")).count().collect()}
    assert {r["hour"]: r["n"] for r in hour_of_day(df).collect()} == expected
    two_stage = hour_of_day_from_buckets(bucket_agg(df, "1 hour", [n_rows()]))
    assert {r["hour"]: r["n"] for r in two_stage.collect()} == expected


def test_top_k_per_group_breaks_ties_by_item(make_events):
    ue = make_events([("a", i, -60.0, s) for i, s in enumerate("zzyyxw")] + [("b", 0, -60.0, "q")])
    got = sorted((r["user_id"], r["ssid"], r["n"]) for r in top_k_per_group(ue, "user_id", "ssid", 3).collect())
    assert got == [("a", "w", 1), ("a", "y", 2), ("a", "z", 2), ("b", "q", 1)]


def test_implicit_group_by_expression(make_events):
    ue = make_events([("a", 0, -60.0, "x"), ("a", 3600, -60.0, "x"), ("b", 3601, -60.0, "x")])
    got = implicit_group(ue, "hour(ts) AS h", "count(*) AS n").orderBy("h").collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 2)]


@pytest.mark.parametrize("block_rows", [1, 7, 1 << 16])
def test_dense_ids(spark, block_rows):
    rng = random.Random(1)
    rows = [(c, p) for c, size in ((10, 50), (2, 300), (1, 1)) for p in rng.sample(range(1000), size)]
    df = spark.createDataFrame(rows, "chunk int, pos bigint").repartition(5)
    got = with_dense_id(df, block_rows=block_rows).collect()
    assert [(r["chunk"], r["pos"]) for r in sorted(got, key=lambda r: r["id"])] == sorted(rows)
    assert sorted(r["id"] for r in got) == list(range(1, len(rows) + 1))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(0, 10**7).map(lambda i: i / 100), st.floats(0, 1e7)), min_size=50, max_size=300))
def test_humanized_durations_round_like_printf(spark, values):
    values = values + [0.25, 0.75, 1450.0, 1050.0, 999.95, 999.949, 1000.0, 0.05, 0.35]
    got = spark.createDataFrame([(v,) for v in values], "ms double").select("ms", humanize_ms("ms").alias("t")).collect()
    for r in got:
        expected = f"{r['ms'] / 1000:.1f}s" if r["ms"] >= 1000 else f"{r['ms']:.1f}ms"
        assert r["t"] == expected


def test_humanized_failures_and_rfc3339(spark):
    df = spark.createDataFrame([(-1.0, dt.datetime(2024, 1, 15, 23, 58, 39, 500000))], "ms double, ts timestamp")
    assert tuple(df.select(humanize_ms("ms"), rfc3339("ts")).first()) == ("N/A", "2024-01-15T23:58:39Z")


def test_exact_percentiles_of_a_million_doubles_in_one_bin(spark):
    """All values share a coarse bin; no task orders more than a part of it."""
    df = spark.range(1_000_000).selectExpr("1000 + ((id * 7919) % 1000003) / 1e7 AS v")
    assert df.selectExpr("v AS _v").selectExpr(f"{stats._bin()} AS b").distinct().count() <= 2
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    got = stats.exact_percentiles(df, "v", probs)
    want = df.selectExpr(*[f"percentile_cont({p}) WITHIN GROUP (ORDER BY v) AS {n}" for n, p in probs.items()]).first()
    assert tuple(got.first()) == pytest.approx(tuple(want), rel=1e-15)
    rows = df.selectExpr("v AS _v").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    sizes = df.selectExpr("v AS _v", f"{rows.lo}D AS _lo", f"{rows.hi}D AS _hi").groupBy(F.expr(stats._PART)).count()
    assert sizes.agg(F.max("count")).first()[0] < 100


@pytest.mark.parametrize("values", [[1.5], [1.5] * 9, [-2.0, -1.0, 0.0, 1e300, 1e-300], [float("inf"), 1.0, float("-inf")], [float("nan"), 2.0, 1.0, None], []])
def test_exact_percentiles_of_odd_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = stats.exact_percentiles(df, "v", {"q": 0.5}).collect()
    want = df.selectExpr("percentile_cont(0.5) WITHIN GROUP (ORDER BY v) AS q").first().q
    assert repr(got[0].q if got else None) == repr(want)


@pytest.mark.parametrize("accuracy", [0.01, 0.0008, 0.00005])
def test_accuracy_of_binned_percentiles(spark, accuracy):
    df = spark.range(20_000).selectExpr("pow(1.0005D, id) AS v")
    got = stats.percentiles(df, "v", {"q": 0.3}, "binned", accuracy=accuracy).first().q
    true = 1.0005 ** int(0.3 * 19_999)
    assert abs(got - true) <= accuracy * true
