import json
import statistics

import pytest
from pyspark.sql import functions as F

from sensorframe.operators import runlog as r
from sensorframe.session import scratch_dir
from sensorframe.sources import build_runlogs, ingest_facts, query_facts, read_runlogs, write_runlogs

LOG = "engine string, run string, chunk int, duration_ms bigint, n_records bigint"
QLOG = "engine string, run string, query_id int, duration_ms bigint"


@pytest.fixture
def log(spark):
    return spark.createDataFrame([
        ("slow", "s1", 0, 1000, 100), ("slow", "s1", 1, 3000, 250), ("slow", "s1", 2, 0, 240),
        ("slow", "s2", 0, 2000, 100), ("slow", "s2", 1, 2000, 300),
        ("fast", "f1", 0, 10, 100), ("fast", "f1", 1, 20, 300),
        ("idle", "i1", 0, 0, 5),
    ], LOG)


@pytest.fixture
def qlog(spark):
    return spark.createDataFrame([
        ("slow", "s1", 1, 100), ("slow", "s2", 1, 300), ("slow", "s1", 2, 50), ("slow", "s2", 2, -1), ("slow", "s1", 3, 0),
        ("fast", "f1", 1, 10), ("fast", "f1", 2, 0), ("fast", "f1", 3, 4),
        ("idle", "i1", 1, -1), ("idle", "i1", 2, 25),
    ], QLOG)


def rows(df, *keys):
    return {tuple(x[k] for k in keys) if len(keys) > 1 else x[keys[0]]: x for x in df.collect()}


def test_counter_diff_within_runs(log):
    got = rows(r.counter_diff(log), "run", "chunk")
    assert [got["s1", c]["delta"] for c in range(3)] == [100, 150, -10]
    assert [got["s2", c]["delta"] for c in range(2)] == [100, 200]


def test_rate_skips_zero_durations(log):
    got = rows(r.ingest_rate(log), "run", "chunk")
    assert set(got) == {("s1", 0), ("s1", 1), ("s2", 0), ("s2", 1), ("f1", 0), ("f1", 1)}
    assert got["s1", 1]["rate"] == 50.0


def test_ingest_stats_pool_the_chunks_of_all_runs(log):
    got = rows(r.ingest_stats(log), "engine")
    slow = got["slow"]
    assert slow["med_duration"] == statistics.median([1000, 3000, 0, 2000, 2000])
    assert slow["med_delta"] == statistics.median([100, 150, 0, 100, 200])
    assert slow["med_rate"] == statistics.median([100, 50, 50, 100])
    assert (slow["total_records"], slow["total_duration"], slow["runs"]) == (270.0, 4000.0, 2)
    assert got["idle"]["med_rate"] == 0.0


def test_query_means_leave_failures_out(qlog):
    got = rows(r.query_means(qlog), "engine", "query_id")
    assert got["slow", 1]["avg_ms"] == 200.0
    assert got["slow", 2]["avg_ms"] == 50.0
    assert got["idle", 1]["avg_ms"] == -1.0
    assert got["fast", 2]["avg_ms"] == 0.0


def test_baseline_is_the_slowest_loader_of_the_most_complete(log, qlog):
    assert r.baseline(r.query_means(qlog), r.ingest_stats(log)).collect()[0]["engine"] == "slow"


def test_speedups(log, qlog):
    means, stats = r.query_means(qlog), r.ingest_stats(log)
    base = r.baseline(means, stats).scalar()
    got = rows(r.speedups(means, base), "engine", "query_id")
    assert {k: v["speedup"] for k, v in got.items()} == {
        ("fast", 1): 20.0, ("fast", 2): 500.0, ("idle", 2): 2.0}  # query 3 took the baseline 0 ms
    summary = rows(r.speedup_summary(means, stats, base), "engine")
    assert tuple(summary["fast"])[1:] == (20.0, 20.0, 500.0, 2)
    assert tuple(summary["idle"])[1:] == (0.0, 2.0, 2.0, 1)  # failed one query, never ran another
    assert tuple(summary["slow"])[1:] == (1.0, 1.0, 1.0, 3)
    loading = rows(r.ingest_speedups(stats, base), "engine")
    assert loading["fast"]["duration_speedup"] == pytest.approx(2000 / 15)
    assert loading["idle"]["duration_speedup"] == pytest.approx(2000 / 0.1)
    assert loading["idle"]["rate_improvement"] == 0.0
    assert tuple(loading["slow"])[1:] == (1.0, 1.0)
    best = rows(r.best(stats, means, base), "metric")
    assert (best["ingest"]["engine"], best["query"]["engine"]) == ("idle", "fast")


def test_failed_baseline_gives_no_speedup(spark, log):
    means = spark.createDataFrame([("slow", 1, -1.0), ("fast", 1, 5.0)], "engine string, query_id int, avg_ms double")
    assert r.speedups(means, F.lit("slow")).count() == 0
    summary = rows(r.speedup_summary(means, r.ingest_stats(log), F.lit("slow")), "engine")
    assert tuple(summary["fast"])[1:] == (0.0, 0.0, 0.0, 0)
    assert summary["slow"]["n"] == 0


def test_pivots(qlog):
    means = r.query_means(qlog)
    times = rows(r.pivot_times(means, ["fast", "idle", "slow"]), "query_id")
    assert tuple(times[1])[1:] == (10.0, -1.0, 200.0)
    assert tuple(times[3])[1:] == (4.0, -1.0, 0.0)
    ratios = rows(r.pivot_speedups(means, F.lit("slow"), ["fast", "idle", "slow"]), "query_id")
    assert tuple(ratios[1])[1:] == (20.0, None, 1.0)
    assert tuple(ratios[3])[1:] == (None, None, 1.0)


def test_file_counts(log):
    assert {k: v["runs"] for k, v in rows(r.file_counts(log), "engine").items()} == {"slow": 2, "fast": 1, "idle": 1}


def test_documents_from_files(spark, tmp_path):
    full = {"dbType": "alpha", "ingestion": [{"durationMs": 5, "nRecords": 10}, {"durationMs": 6, "nRecords": 30}],
            "queries": [{"queryId": 1, "durationMs": 2, "description": "Count"}, {"queryId": 2, "durationMs": -1}]}
    (tmp_path / "alphaBenchmark_1.json").write_text(json.dumps(full))
    del full["dbType"]
    (tmp_path / "beta_7.json").write_text(json.dumps(full, indent=2))
    docs = read_runlogs(spark, str(tmp_path))
    assert sorted((d["engine"], d["run"]) for d in docs.collect()) == [
        ("alpha", f"file:{tmp_path}/alphaBenchmark_1.json"), ("beta_7", f"file:{tmp_path}/beta_7.json")]
    loaded = ingest_facts(docs).filter("engine = 'alpha'").orderBy("chunk").collect()
    assert [(x["chunk"], x["duration_ms"], x["n_records"]) for x in loaded] == [(0, 5, 10), (1, 6, 30)]
    asked = query_facts(docs).filter("engine = 'alpha'").orderBy("query_id").collect()
    assert [(x["query_id"], x["duration_ms"], x["description"]) for x in asked] == [(1, 2, "Count"), (2, -1, "Query 2")]


def test_written_documents_read_back(spark, log, qlog):
    odd = log.withColumns({"engine": F.concat("engine", F.lit(" db/x")), "run": F.concat(F.lit("r: "), "run", F.lit("/%20=é"))})
    asked = qlog.withColumns({"engine": F.concat("engine", F.lit(" db/x")), "run": F.concat(F.lit("r: "), "run", F.lit("/%20=é")), "description": F.lit("d")})
    path, again = scratch_dir(spark, "logs"), scratch_dir(spark, "logs")
    write_runlogs(build_runlogs(odd, asked), path)
    docs = read_runlogs(spark, path)
    assert sorted(map(tuple, ingest_facts(docs).collect())) == sorted(map(tuple, odd.collect()))
    assert query_facts(docs).count() == qlog.count()
    write_runlogs(build_runlogs(ingest_facts(docs), query_facts(docs)), again)
    assert sorted(map(repr, read_runlogs(spark, again).collect())) == sorted(map(repr, docs.collect()))


def test_equal_file_names_in_two_folders_are_two_runs(spark, tmp_path):
    for folder, records in (("m1", 10), ("m2", 20)):
        (tmp_path / folder).mkdir()
        doc = {"dbType": "z", "ingestion": [{"durationMs": 5, "nRecords": records}], "queries": []}
        (tmp_path / folder / "z_1.json").write_text(json.dumps(doc))
    facts = ingest_facts(read_runlogs(spark, [f"{tmp_path}/m1", f"{tmp_path}/m2"]))
    assert sorted(x.delta for x in r.counter_diff(facts).collect()) == [10, 20]
    assert r.file_counts(facts).first()["runs"] == 2


def test_pivots_show_every_engine_and_the_description(spark):
    means = spark.createDataFrame(
        [(f"e{k}", q, float(10 * k + q), f"Query {q}") for k in range(6) for q in (1, 2) if (k, q) != (5, 2)],
        "engine string, query_id int, avg_ms double, description string")
    times = rows(r.pivot_times(means), "query_id")
    assert times[2].asDict() == {"query_id": 2, "description": "Query 2", **{f"e{k}": 10.0 * k + 2 for k in range(5)}, "e5": -1.0}
    assert r.pivot_speedups(means, F.lit("e1")).columns == ["query_id", "description", *[f"e{k}" for k in range(6)]]
    with pytest.raises(ValueError, match="outside the given list"):
        r.pivot_times(means, ["e0", "e1"])
    assert r.pivot_times(means.limit(0)).columns == ["query_id", "description"]


def test_summary_of_an_even_suite(spark, log):
    means = spark.createDataFrame([("slow", q, 100.0) for q in range(4)] + [("fast", 0, 10.0), ("fast", 1, 50.0), ("fast", 2, -1.0)],
                                  "engine string, query_id int, avg_ms double")
    got = rows(r.speedup_summary(means, r.ingest_stats(log), F.lit("slow")), "engine")
    assert tuple(got["fast"])[1:] == (statistics.median([0, 0, 2, 10]), 2.0, 10.0, 2)
    assert tuple(got["idle"])[1:] == (0.0, 0.0, 0.0, 0)
