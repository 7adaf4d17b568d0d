"""Counts, means, spans and percentiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions import micros_between, n_rows, spread_of
from sensorframe.session import materialize


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(n_rows())


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Exact number of distinct values."""
    return df.agg(F.count_distinct(column).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def mean(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(F.avg(column).alias(name))


def series_agg(df: DataFrame, aggs: Sequence[Column], series: Sequence[str] = ("user_id", "ssid")) -> DataFrame:
    """Aggregate per series: one group per combination of tags."""
    return df.groupBy(*series).agg(*aggs)


def spread(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, spread)``: largest minus smallest value per key."""
    return df.groupBy(key).agg(spread_of(column).alias("spread"))


def activity_span(df: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """``(key, span_us)``: microseconds between a key's first and last row."""
    return df.groupBy(key).agg(micros_between(F.min(ts), F.max(ts)).alias("span_us"))


def implicit_group(df: DataFrame, *items: str) -> DataFrame:
    """Aggregate query without a GROUP BY: every item that is no aggregate becomes a grouping key."""
    return df.sparkSession.sql(f"SELECT {', '.join(items)} FROM {{df}} GROUP BY ALL", df=df)


# Percentiles. A histogram of coarse bins, whose number is bounded, tells which few bins hold the wanted
# ranks; only the values of those bins are then counted and ordered. No task ever sees all values, and
# a value held by a third of all rows is one counter per task.

ROOTS = 6
BIN_SCALE = 40_000

# Bin number of a value `_v`, which never decreases with it: the 64th root, scaled and cut to an integer.
# Like a logarithm it gives bins of similar relative width over the whole range, but works for both signs
# and zero, and square roots are much cheaper. A REAL column has at most 320,000 bins of at most 100,000
# distinct values each. NaN shares the last bin with infinity. The outer coalesce only tells the optimizer
# that a bin is never null.
_ROOT = f"{'sqrt(' * ROOTS}abs(_v){')' * ROOTS}"


def _bin(scale: int = BIN_SCALE) -> str:
    return f"coalesce(floor(nanvl(signum(_v) * {_ROOT}, double('infinity')) * {scale}), 0L)"


def _bin_middle(scale: int) -> str:
    """A representative value of a bin, for magnitudes above 1 at most 32 / ``scale`` of it away from the values in it."""
    root = f"((_bin + 0.5D) / {scale})"
    return f"signum({root}) * pow(abs({root}), {2 ** ROOTS})"


# A DOUBLE column may have any number of distinct values in a bin. The bins hit are cut into this many equal parts
# between their smallest and largest value, and only the parts hit are counted by value.
PARTS = 1 << 16
_PART = f"coalesce(floor(nanvl((_v - _lo) / nullif(_hi - _lo, 0D), 0D) * {PARTS}), 0L)"


# The same for intervals that may reach to infinity or hold NaN, each of which gets a part of its own. The smallest and the largest value of an
# interval are never in one part.
_OWN_PART = f"CASE WHEN isnan(_v) THEN {PARTS + 2} WHEN _v = double('infinity') THEN {PARTS + 1} WHEN _v = double('-infinity') THEN -1 ELSE {_PART} END"


def _values(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """The values of a column as doubles, each counting once."""
    return df.select(*keys, F.col(column).cast("double").alias("_v"), F.lit(1).cast("bigint").alias("_n")).filter("_v IS NOT NULL")


def _counted(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.sum("_n").alias("_n"))


def _running_bins(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per bin as ``_rows``, the rows in smaller bins as ``_before``, all rows as ``_total``."""
    part = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)}" if keys else ""
    bins = rows.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return bins.selectExpr(
        "*",
        f"coalesce(sum(_rows) OVER ({part} ORDER BY _bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before",
        f"sum(_rows) OVER ({part}) AS _total")


def _rank(p: float) -> str:
    """Position of a percentile among ``_total`` sorted rows, counted from 0; it may lie between two rows."""
    return f"({float(p)!r}D * (_total - 1))"


def exact_percentiles(df: DataFrame, column: str, probs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated percentiles: one column per entry of ``probs``, one row per key.

    Equal to ``percentile_cont``, without its map of all distinct values in a single task. Over a
    whole table the column is scanned twice, and only bin counts and the values of the bins hit are
    shuffled. A DOUBLE column is scanned three times: the bins hit are cut once more, so that a task gets
    the values of 1 / 65,536 of a bin's range. With ``keys`` the bins hit are cut again and again, of all keys at once,
    until each holds one value (see ``_narrowed``): no task gets a key's values, however many there are. That runs jobs at
    once, one a round.
    """
    edges = ", ".join(f"floor({_rank(p)}), ceil({_rank(p)})" for p in probs.values())

    def inside(before: str, n: str) -> str:
        """The wanted ranks that fall on the ``n`` rows after the first ``before`` rows."""
        return f"filter(array_distinct(array({edges})), r -> r >= {before} AND r < {before} + {n})"

    binned = _values(df, column, keys).selectExpr("*", f"{_bin()} AS _bin")
    if keys:
        ranked = _narrowed(binned, keys, inside).selectExpr(*[f"`{k}`" for k in keys], "_total", "_lo AS _v", "_before AS _first", "_rows AS _n")
    else:
        ranked = _ranked(binned, inside, isinstance(df.select(column).schema[0].dataType, (T.FloatType, T.ByteType, T.ShortType)))
    found = ranked.selectExpr(*[f"`{k}`" for k in keys], "_total", "_v", f"explode({inside('_first', '_n')}) AS _rank")
    # one entry per wanted rank
    at = found.groupBy(*keys).agg(F.expr("first(_total) AS _total"), F.expr("map_from_entries(collect_list(struct(_rank, _v))) AS _at"))

    def interpolated(p: float) -> str:
        r = _rank(p)
        lo, hi, share = f"_at[floor({r})]", f"_at[ceil({r})]", f"({r} - floor({r}))"
        return f"if({share} = 0, {lo}, {lo} * (1 - {share}) + {hi} * {share})"

    return at.selectExpr(*[f"`{k}`" for k in keys], *[f"{interpolated(p)} AS `{name}`" for name, p in probs.items()])


def _ranked(rows: DataFrame, inside: Callable[[str, str], str], few_values: bool) -> DataFrame:
    """``(_total, _v, _n, _first)`` of the values of the whole table that may have a wanted rank."""
    hit = _running_bins(rows, ()).filter(f"size({inside('_before', '_rows')}) > 0").drop("_rows")
    if few_values:
        # at most two bins per percentile
        values = _counted(rows.join(F.broadcast(hit), "_bin"), "_bin", "_v", "_before", "_total")
    else:
        parts = rows.join(F.broadcast(hit), "_bin").selectExpr("_bin", "_before", "_total", "_lo", "_hi", "_n", f"{_PART} AS _part")
        by_part = parts.groupBy("_bin", "_part", "_before", "_total", "_lo", "_hi").agg(F.sum("_n").alias("_rows"))
        start = "_before + coalesce(sum(_rows) OVER (PARTITION BY _bin ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"
        cut = by_part.selectExpr("_bin", "_part", "_lo", "_hi", "_total", "_rows", f"{start} AS _before")
        cut = cut.filter(f"size({inside('_before', '_rows')}) > 0").select("_bin", "_part", "_total", "_before")
        bounds = hit.select("_bin", "_lo", "_hi")
        rows = rows.join(F.broadcast(bounds), "_bin").selectExpr("_v", "_n", "_bin", f"{_PART} AS _part")
        # at most two parts per percentile
        found_in = _counted(rows.join(F.broadcast(cut), ["_bin", "_part"]), "_bin", "_part", "_v", "_before", "_total")
        values = found_in.withColumn("_bin", F.struct("_bin", "_part")).drop("_part")
    upto = Window.partitionBy("_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return values.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))


def _narrowed(rows: DataFrame, keys: Sequence[str], inside: Callable[[str, str], str]) -> DataFrame:
    """``(*keys, _total, _before, _rows, _lo, _hi)``: per key the single values, ``_lo`` equal to ``_hi``, that hold its wanted ranks.

    Starts with the bins that hold them. Each round cuts every interval that still holds several values into 65,536 equal parts
    between its smallest and largest value, counts them, and keeps the parts with a wanted rank. Only counts are shuffled and ordered, and
    three rounds resolve more than the digits of a double inside a bin; more are needed only next to zero.
    """
    names = [f"`{k}`" for k in keys]
    columns = [*names, "_total", "_before", "_rows", "_lo", "_hi"]
    wanted = f"size({inside('_before', '_rows')}) > 0"
    values = rows.select(*keys, "_v", "_n")
    now = materialize(_running_bins(rows, keys).filter(wanted).selectExpr(*columns), "percentile-bins")
    single = now.filter("_lo <=> _hi")
    while not (several := now.filter("NOT (_lo <=> _hi)")).isEmpty():
        around = several.selectExpr(*[f"{n} AS `_of_{k}`" for n, k in zip(names, keys, strict=True)], "_total", "_before", "_lo", "_hi")
        same = " AND ".join(f"{n} <=> `_of_{k}`" for n, k in zip(names, keys, strict=True))  # null is a key like others
        parts = values.join(around, F.expr(f"{same} AND _v >= _lo AND _v <= _hi")).selectExpr("*", f"{_OWN_PART} AS _part")
        counts = parts.groupBy(*keys, "_total", "_before", F.col("_lo").alias("_from"), "_part").agg(
            F.sum("_n").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        earlier = f"sum(_rows) OVER (PARTITION BY {', '.join(names)}, _from ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        placed = counts.selectExpr(*names, "_total", f"_before + coalesce({earlier}, 0L) AS _before", "_rows", "_lo", "_hi")
        now = materialize(placed.filter(wanted), "percentile-parts")
        single = single.union(now.filter("_lo <=> _hi"))
    return single


def binned_percentiles(df: DataFrame, column: str, probs: dict[str, float], keys: Sequence[str] = (), accuracy: float = 0.0008) -> DataFrame:
    """Percentiles within ``accuracy`` (a share, for magnitudes above 1) of a value at the wanted rank, from coarse bins.

    Needs one aggregation into a bounded number of bins, is mergeable and repeatable, and takes
    negative values as they are. The value at rank ``floor(p * (n - 1))`` is reported.
    """
    scale = ceil(32 / accuracy)
    bins = _running_bins(_values(df, column, keys).selectExpr("*", f"{_bin(scale)} AS _bin"), keys)

    def at(p: float, name: str) -> Column:
        rank = f"floor({_rank(p)})"
        return F.expr(f"max(if({rank} >= _before AND {rank} < _before + _rows, {_bin_middle(scale)}, NULL)) AS `{name}`")

    return bins.groupBy(*keys).agg(*[at(p, name) for name, p in probs.items()])


def sketch_percentiles(df: DataFrame, column: str, probs: dict[str, float], k: int = 2000, fan_in: int = 256) -> DataFrame:
    """Percentiles from mergeable quantile sketches, with a bounded rank error (about 0.15 % at ``k`` = 2000).

    Sketches of single tasks are first merged in ``fan_in`` groups, so that the last step merges
    ``fan_in`` sketches however many tasks the scan had.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(fan_in)).alias("_group")
    part = df.select(group, F.col(column).cast("double").alias("_v")).groupBy("_group").agg(
        F.kll_sketch_agg_double("_v", k).alias("_sketch"))
    whole = part.agg(F.kll_merge_agg_double("_sketch", k).alias("_sketch"))
    return whole.select(*[F.kll_sketch_get_quantile_double("_sketch", F.lit(p)).alias(name) for name, p in probs.items()])


def percentiles(df: DataFrame, column: str, probs: dict[str, float], method: str = "exact",
                keys: Sequence[str] = (), accuracy: float = 0.0008) -> DataFrame:
    """``exact`` (interpolated), ``binned`` (relative error up to ``accuracy``) or ``sketch`` (bounded rank error, no keys)."""
    if method == "exact":
        return exact_percentiles(df, column, probs, keys)
    if method == "binned":
        return binned_percentiles(df, column, probs, keys, accuracy)
    if method == "sketch" and not keys:
        return sketch_percentiles(df, column, probs)
    raise ValueError(f"no percentile method {method!r} with keys {list(keys)}")
