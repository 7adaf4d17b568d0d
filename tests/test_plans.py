"""Properties every registered plan keeps, checked on the physical plan."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from sensorframe.plans import QUERIES, core, runlogs, variants

PURE = sorted({**core.QUERIES, **variants.QUERIES, **{k: v for k, v in runlogs.QUERIES.items() if k.startswith("r_")}})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PURE)
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "Existing RDD"):
        assert bad not in text


@pytest.mark.parametrize("name, columns", [
    ("q01_time_bounds", "struct<ts:timestamp>"), ("q02_count_all", "struct<>"), ("q04_avg_rssi", "struct<value:double>"),
    ("q09_top_users", "struct<user_id:bigint>"), ("q12_top_ssids", "struct<props:string>"),
    ("q17_hour_of_day", "struct<ts:timestamp>"),
])
def test_scans_read_only_what_is_asked(spark, name, columns):
    assert f"ReadSchema: {columns}" in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["q09_top_users", "q12_top_ssids", "q13_user_rssi_stats", "q19_peak_hours", "q20_activity_span"])
def test_top_k_does_not_sort_the_table(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


@pytest.mark.parametrize("name", ["v_topn_per_group", "v_series_peak_hours"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


@pytest.mark.parametrize("name", ["q03_distinct_users", "q13_user_rssi_stats", "q18_daily_variance", "points_upsert"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "partial_" in text and "SortAggregate" not in text


def test_run_logs_read_the_events_once_each(spark):
    """Two logs, each aggregated once and kept: what comes after reads neither the events nor scratch files."""
    QUERIES["r_best"](spark, SF).collect()
    for name in ("r_baseline", "r_best", "r_speedup_summary", "r_pivot_speedups"):
        df = QUERIES[name](spark, SF)
        top = df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert "FileScan" not in top
        assert df.collect()


def test_buckets_are_grouped_and_joined_where_they_lie(spark, tmp_path):
    """No shuffle; the one of a table without buckets shows that the plan has a need for one."""
    from sensorframe.plans.loading import bucketed_counts
    from sensorframe.plans.tables import user_events
    from sensorframe.sources import write_bucketed

    plain = user_events(spark, SF)
    assert "Exchange" in plan(bucketed_counts(plain))
    found = bucketed_counts(write_bucketed(plain, "bucketed_events", f"{tmp_path}/b", buckets=8))
    found.collect()
    assert "Exchange" not in plan(found) and "SortMergeJoin" in plan(found) and "Bucketed: true" in plan(found)


def test_keyed_percentiles_order_counts_only(spark, monkeypatch):
    """A key with nine tenths of a million distinct doubles: each round orders counts of parts, never the values."""
    from sensorframe.operators import stats

    rows = spark.range(1_000_000).selectExpr(
        "CASE WHEN id % 10 = 0 THEN CAST(id % 30 AS STRING) WHEN id % 7919 = 1 THEN NULL ELSE 'hot' END AS k", "1000 + ((id * 7919) % 1000003) / 1e7 AS v")
    written = []
    monkeypatch.setattr(stats, "materialize", lambda df, label, write=stats.materialize: written.append(df) or write(df, label))
    probs = {"a": 0.001, "b": 0.5, "c": 0.9999}
    got = stats.exact_percentiles(rows, "v", probs, ["k"])
    want = rows.groupBy("k").agg(*[F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY v)").alias(n) for n, p in probs.items()])
    assert {r.k: pytest.approx(tuple(r)[1:], rel=1e-15) for r in want.collect()} == {r.k: tuple(r)[1:] for r in got.collect()}
    assert 2 <= len(written) <= 5
    for df in written:
        text = plan(df)
        assert "Window" in text and "partial_sum" in text
        below = text[text.index("Window"):]
        assert "HashAggregate" in below or "SortAggregate" in below  # counts are made before the window orders them
        assert df.count() < 1000


def test_keyed_percentiles_of_odd_doubles(spark):
    inf, nan = float("inf"), float("nan")
    groups = {
        "one": [1.5], "tiny": [5e-324, 1e-323, 1.5e-323, 1e-310, 0.0, -5e-324], "inf": [-inf, -inf, 1.0, inf, inf], "nan": [nan, 2.0, inf, nan],
        "mixed": [1e300, -1e300, 1e-300, 3.0], "null": [None], None: [4.0, 5.0], "zero": [0.0, -0.0, 0.0],
    }
    rows = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "k string, v double")
    from sensorframe.operators.stats import exact_percentiles

    got = {r.k: (r.lo, r.q, r.hi) for r in exact_percentiles(rows, "v", {"lo": 0.0, "q": 0.75, "hi": 1.0}, ["k"]).collect()}
    want = rows.groupBy("k").agg(*[F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY v)").alias(n) for n, p in (("lo", 0.0), ("q", 0.75), ("hi", 1.0))])
    expected = {r.k: tuple(r)[1:] for r in want.collect() if r.k != "null"}
    assert {k: tuple(map(str, v)) for k, v in got.items()} == {k: tuple(map(str, (x + 0.0 for x in v))) for k, v in expected.items()}
