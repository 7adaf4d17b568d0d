"""Run-log analysis. Each log is aggregated once, the steps after that work on the small result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.operators import runlog as r
from sensorframe.plans.tables import ingest_log, once_key, run_log, staged_runlogs
from sensorframe.session import scratch_dir
from sensorframe.sources import build_runlogs, ingest_facts, query_facts, read_runlogs, write_runlogs

_kept: dict[tuple, DataFrame | str | None] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable):
    key = once_key(spark, sf_dir, what)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load log, aggregated once per session and input: a row per engine, run and day."""
    return _once(spark, sf_dir, "log", lambda: ingest_log(spark, sf_dir).persist())


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        described = run_log(spark, sf_dir).withColumn("description", F.concat(F.lit("Query "), F.col("query_id").cast("string")))
        return r.query_means(described).persist()

    return _once(spark, sf_dir, "means", make)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "stats", lambda: r.ingest_stats(_log(spark, sf_dir)).persist())


def _base(spark: SparkSession, sf_dir: str) -> Column:
    """The baseline's name, found once: as a subquery it would be repeated in every branch of the plans."""
    def make() -> str | None:
        row = r.baseline(_means(spark, sf_dir), _stats(spark, sf_dir)).first()
        return row and row[0]

    return F.lit(_once(spark, sf_dir, "base", make)).cast("string")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _facts(docs: DataFrame) -> DataFrame:
    """Both lists of the documents as one table."""
    loaded = ingest_facts(docs).select(
        "engine", "run", F.lit("ingest").alias("kind"), F.col("chunk").alias("item"), "duration_ms", "n_records")
    asked = query_facts(docs).select(
        "engine", "run", F.lit("query").alias("kind"), F.col("query_id").alias("item"), "duration_ms",
        F.lit(None).cast("bigint").alias("n_records"))
    return loaded.unionByName(asked)


def runlog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(read_runlogs(spark, staged_runlogs(spark, sf_dir)))


def runlog_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read, rebuilt from their facts, written again and counted."""
    docs = read_runlogs(spark, staged_runlogs(spark, sf_dir))
    path = scratch_dir(spark, "runlogs-again")
    write_runlogs(build_runlogs(ingest_facts(docs), query_facts(docs)), path)
    return read_runlogs(spark, path).select(
        "engine", "run", F.size("ingestion").alias("n_chunks"), F.size("queries").alias("n_queries"),
        F.array_max("ingestion.nRecords").alias("n_records"))


def r_counter_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.counter_diff(_log(spark, sf_dir)).select("engine", "run", "chunk", "delta")


def r_ingest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(r.ingest_rate(_log(spark, sf_dir)), "rate")


def r_ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_stats(spark, sf_dir), "med_rate", "total_records", "total_duration")


def r_query_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_means(spark, sf_dir), "avg_ms").drop("description")


def r_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.baseline(_means(spark, sf_dir), _stats(spark, sf_dir))


def r_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(r.speedups(_means(spark, sf_dir), _base(spark, sf_dir)), "speedup")


def r_ingest_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.ingest_speedups(_stats(spark, sf_dir), _base(spark, sf_dir))
    return _rounded(found, "duration_speedup", "rate_improvement")


def r_speedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.speedup_summary(_means(spark, sf_dir), _stats(spark, sf_dir), _base(spark, sf_dir))
    return _rounded(found, "median", "min", "max")


def r_pivot_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = r.pivot_times(_means(spark, sf_dir))
    return _rounded(wide, *[c for c in wide.columns if c not in ("query_id", "description")])


def r_pivot_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = r.pivot_speedups(_means(spark, sf_dir), _base(spark, sf_dir))
    return _rounded(wide, *[c for c in wide.columns if c not in ("query_id", "description")])


def r_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(r.best(_stats(spark, sf_dir), _means(spark, sf_dir), _base(spark, sf_dir)), "speedup")


def r_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.file_counts(_log(spark, sf_dir))


QUERIES = {q.__name__: q for q in (
    runlog_scan, runlog_write, r_counter_diff, r_ingest_rate, r_ingest_stats, r_query_means, r_baseline,
    r_speedups, r_ingest_speedups, r_speedup_summary, r_pivot_times, r_pivot_speedups, r_best, r_file_counts,
)}
