"""Analysis of run logs: load rates, query times, the baseline engine and speedups over it.

``log`` has one row per loaded chunk (``engine, run, chunk, duration_ms, n_records``), ``qlog`` one
row per query execution (``engine, run, query_id, duration_ms[, description]``), where -1 stands for failed.
``base`` is the baseline's name, as a literal or ``baseline(..).scalar()``. ``query_means`` and ``ingest_stats``
are used several times by the steps after them; on large logs persist them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.operators.stats import exact_percentiles

#: A measured 0 ms counts as this many milliseconds when it divides.
FASTEST_MS = 0.1


def counter_diff(log: DataFrame) -> DataFrame:
    """``engine, run, chunk, duration_ms, delta``: records of each chunk from the run's running counter.

    The window holds the chunks of one run, which come from a single log document.
    """
    before = F.lag("n_records").over(Window.partitionBy("engine", "run").orderBy("chunk"))
    return log.select("engine", "run", "chunk", "duration_ms", (F.col("n_records") - F.coalesce(before, F.lit(0))).alias("delta"))


def _rate() -> Column:
    return F.when(F.col("duration_ms") > 0, F.col("delta") * 1000.0 / F.col("duration_ms"))


def ingest_rate(log: DataFrame) -> DataFrame:
    """``engine, run, chunk, rate``: records per second, for chunks with a positive duration."""
    return counter_diff(log).filter("duration_ms > 0").select("engine", "run", "chunk", _rate().alias("rate"))


def ingest_stats(log: DataFrame) -> DataFrame:
    """``engine, med_duration, med_delta, med_rate, total_records, total_duration, runs``.

    Medians pool all chunks of all runs of an engine, with negative values raised to 0; totals are
    means over the runs. The three medians are found together, as three metrics of one long table.
    """
    chunks = counter_diff(log).withColumn("rate", _rate())
    metrics = chunks.select("engine", F.expr(
        "stack(3, 'duration', greatest(0D, duration_ms), 'delta', greatest(0D, delta), "
        "'rate', if(rate IS NULL, NULL, greatest(0D, rate))) AS (metric, value)"))
    medians = exact_percentiles(metrics, "value", {"med": 0.5}, ["engine", "metric"]).groupBy("engine").agg(*[
        F.coalesce(F.max(F.when(F.col("metric") == m, F.col("med"))), F.lit(0.0)).alias(f"med_{m}")
        for m in ("duration", "delta", "rate")
    ])
    runs = log.groupBy("engine", "run").agg(
        F.max_by("n_records", "chunk").alias("n_records"), F.sum("duration_ms").alias("duration_ms"))
    totals = runs.groupBy("engine").agg(
        F.avg("n_records").alias("total_records"), F.avg("duration_ms").alias("total_duration"),
        F.count("*").alias("runs"))
    return medians.join(totals, "engine")


def query_means(qlog: DataFrame) -> DataFrame:
    """``engine, query_id, avg_ms``: mean over the runs that succeeded; -1 where none did.

    A ``description`` of the queries is carried along.
    """
    ok = F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))
    described = [F.max("description").alias("description")] if "description" in qlog.columns else []
    return qlog.groupBy("engine", "query_id").agg(F.coalesce(F.avg(ok), F.lit(-1.0)).alias("avg_ms"), *described)


def baseline(means: DataFrame, stats: DataFrame) -> DataFrame:
    """One row ``engine``: of the engines that completed most queries, the one slowest at loading.

    Only engines with load statistics take part. Equal engines are ordered by name.
    """
    completed = means.filter("avg_ms >= 0").groupBy("engine").agg(F.count("*").alias("done"))
    ranked = stats.select("engine", "med_duration").join(completed, "engine", "left").select(
        "engine", F.coalesce("done", F.lit(0)).alias("done"), "med_duration")
    return ranked.orderBy(F.desc("done"), F.desc("med_duration"), "engine").limit(1).select("engine")


def _ratio(base: Column, value: Column) -> Column:
    """``base / value``; null where the value failed or there is nothing to divide."""
    return F.when(base > 0, F.when(value > 0, base / value).when(value == 0, base / FASTEST_MS))


def _all_ratios(means: DataFrame, base: Column) -> DataFrame:
    """``engine, query_id, speedup`` for every mean: 1 for the baseline, null where there is no speedup."""
    ref = means.filter(F.col("engine") == base).select("query_id", F.col("avg_ms").alias("base_ms"))
    ratio = F.when(F.col("engine") == base, 1.0).otherwise(_ratio(F.col("base_ms"), F.col("avg_ms")))
    return means.join(ref, "query_id", "left").select("engine", "query_id", ratio.alias("speedup"))


def speedups(means: DataFrame, base: Column) -> DataFrame:
    """``engine, query_id, speedup`` over the baseline, for every other engine and query that has one."""
    return _all_ratios(means, base).filter((F.col("engine") != base) & F.col("speedup").isNotNull())


def ingest_speedups(stats: DataFrame, base: Column) -> DataFrame:
    """``engine, duration_speedup, rate_improvement``; the baseline itself is 1."""
    own = stats.filter(F.col("engine") == base)
    base_duration, base_rate = own.select("med_duration").scalar(), own.select("med_rate").scalar()
    is_base = F.col("engine") == base
    rate = F.when(base_rate > 0, F.col("med_rate") / base_rate).otherwise(0.0)
    return stats.select(
        "engine",
        F.when(is_base, 1.0).otherwise(_ratio(base_duration, F.col("med_duration"))).alias("duration_speedup"),
        F.when(is_base, 1.0).otherwise(rate).alias("rate_improvement"),
    ).filter("duration_speedup IS NOT NULL")


def speedup_summary(means: DataFrame, stats: DataFrame, base: Column) -> DataFrame:
    """``engine, median, min, max, n``: speedups of each engine over all queries of the suite.

    A query an engine failed or never ran counts as 0 in the median, and not in the other columns.
    The baseline is 1, with the number of queries it completed.
    """
    n_suite = means.agg(F.count_distinct("query_id")).scalar()
    by_speed = Window.partitionBy("engine").orderBy("speedup")
    # ranks among all queries of the suite: those without a speedup come first, as zeros
    ranked = _all_ratios(means, base).filter("speedup IS NOT NULL").select(
        "engine", "speedup", n_suite.alias("n_suite"),
        (F.row_number().over(by_speed) + n_suite - F.count("*").over(Window.partitionBy("engine"))).alias("rank"))
    half = [F.floor((F.col("n_suite") + k) / 2) for k in (1, 2)]
    at = [F.coalesce(F.max(F.when(F.col("rank") == h, F.col("speedup"))), F.lit(0.0)) for h in half]
    scored = ranked.groupBy("engine").agg(
        ((at[0] + at[1]) / 2).alias("median"), F.min("speedup").alias("min"), F.max("speedup").alias("max"), F.count("*").alias("n"))
    done = means.filter((F.col("engine") == base) & (F.col("avg_ms") >= 0)).agg(F.count("*")).scalar()
    is_base = F.col("engine") == base
    return stats.select("engine").join(scored, "engine", "left").select(
        "engine",
        *[F.when(is_base, 1.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("median", "min", "max")],
        F.when(is_base, done).otherwise(F.coalesce("n", F.lit(0))).alias("n"),
    )


#: A pivot has a column for each engine; a log with more engines than this is better left long.
MAX_ENGINES = 1000


def _engines(means: DataFrame, engines: Sequence[str] | None) -> list[str]:
    """The engines of the log, by name. A given list must hold all of them, and may hold more."""
    found = [r[0] for r in means.select("engine").distinct().orderBy("engine").limit(MAX_ENGINES + 1).collect()]
    if len(found) > MAX_ENGINES:
        raise ValueError(f"more than {MAX_ENGINES} engines")
    if engines is None:
        return found
    if missing := sorted(set(found) - set(engines)):
        raise ValueError(f"engines outside the given list: {missing}")
    return list(engines)


def _wide(rows: DataFrame, means: DataFrame, value: str, engines: list[str]) -> DataFrame:
    """``query_id[, description]`` and a column per engine."""
    wide = rows.groupBy("query_id").pivot("engine", engines).agg(F.first(value)) if engines else rows.select("query_id").distinct()
    if "description" not in means.columns:
        return wide
    described = means.groupBy("query_id").agg(F.max("description").alias("description"))
    return described.join(wide, "query_id").select("query_id", "description", *[F.col(f"`{e}`") for e in engines])


def pivot_times(means: DataFrame, engines: Sequence[str] | None = None) -> DataFrame:
    """``query_id[, description]`` and one column of mean times per engine of the log; -1 where an engine has none."""
    names = _engines(means, engines)
    return _wide(means, means, "avg_ms", names).fillna(-1.0, names)


def pivot_speedups(means: DataFrame, base: Column, engines: Sequence[str] | None = None) -> DataFrame:
    """``query_id[, description]`` and one column of speedups per engine; 1 for the baseline, null where there is none."""
    return _wide(_all_ratios(means, base), means, "speedup", _engines(means, engines))


def best(stats: DataFrame, means: DataFrame, base: Column) -> DataFrame:
    """``metric, engine, speedup``: the fastest engine at loading, and by median query speedup."""
    def winner(rows: DataFrame, metric: str, value: str) -> DataFrame:
        return rows.filter(F.col("engine") != base).orderBy(F.desc(value), "engine").limit(1).select(
            F.lit(metric).alias("metric"), "engine", F.col(value).alias("speedup"))

    return winner(ingest_speedups(stats, base), "ingest", "duration_speedup").unionByName(
        winner(speedup_summary(means, stats, base), "query", "median"))


def file_counts(log: DataFrame) -> DataFrame:
    """``engine, runs``: number of logged runs per engine."""
    return log.groupBy("engine").agg(F.count_distinct("run").alias("runs"))
