"""Time bounds and slices of an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions import DAY_US, HOUR_US, midpoint_of, shift

#: Width of one time partition of the ``time`` table layout, in hours, and the column the layout goes by.
PART_HOURS = 4
LAYOUT_TS = "ts"

#: Where a table derives ``ts`` by cutting instants to seconds, the instants themselves. File statistics know
#: these only, so bounds of ``ts`` are put on them too.
UNCUT_TS = "_uncut_ts"


def _has_time_layout(df: DataFrame, ts: str) -> bool:
    return ts == LAYOUT_TS and {"event_date", "part_hour"} <= set(df.columns)


def _part_number() -> Column:
    """The partition of a row of the time layout as hours since the epoch."""
    return F.unix_date("event_date") * 24 + F.col("part_hour")


def time_bounds(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row ``(min_ts, max_ts)``; both null for an empty table.

    On a table in the ``time`` layout only the first and the last partition are read: which ones
    these are follows from partition values and file footers.
    """
    if _has_time_layout(df, ts):
        edges = df.agg(F.min(_part_number()).alias("first"), F.max(_part_number()).alias("last"))
        first, last = edges.select("first").scalar(), edges.select("last").scalar()
        df = df.filter((_part_number() == first) | (_part_number() == last))
    return df.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def bound(df: DataFrame, expr: Column, ts: str = "ts") -> Column:
    """A value computed from ``min_ts`` and ``max_ts`` of the table, as a scalar subquery.

    A subquery, unlike a join with a one-row table, is evaluated first and then a plain bound of the
    scan. Arithmetic belongs into ``expr``, where it is done once and not for every row. Several
    bounds of one table are computed together.
    """
    return time_bounds(df, ts).select(expr.alias("bound")).scalar()


def earliest(df: DataFrame, ts: str = "ts") -> Column:
    return bound(df, F.col("min_ts"), ts)


def latest(df: DataFrame, ts: str = "ts") -> Column:
    return bound(df, F.col("max_ts"), ts)


def midpoint(df: DataFrame, ts: str = "ts", plus_hours: int = 0) -> Column:
    """Middle of the table's time range, moved by ``plus_hours``."""
    mid = midpoint_of("min_ts", "max_ts")
    return bound(df, shift(mid, plus_hours) if plus_hours else mid, ts)


def instants(df: DataFrame, *exprs: Column, ts: str = "ts") -> list[Column]:
    """Values computed from ``min_ts`` and ``max_ts`` of the table, as literals.

    Runs one aggregate at once. For a slice with two bounds: Spark merges the subqueries of two bounds of one
    table into one, and then neither reaches the file statistics, whereas literals do.
    """
    row = time_bounds(df, ts).select(*[F.unix_micros(e).alias(f"_{k}") for k, e in enumerate(exprs)]).first()
    return [F.lit(None).cast("timestamp") if us is None else F.timestamp_micros(F.lit(us)) for us in row]


def around_midpoint(df: DataFrame, *hours: int, ts: str = "ts") -> list[Column]:
    """The instants so many hours after the middle of the table's time range, as literals."""
    mid = midpoint_of("min_ts", "max_ts")
    return instants(df, *[shift(mid, h) if h else mid for h in hours], ts=ts)


def part_hour(ts: Column) -> Column:
    """First hour of the time partition a timestamp falls in (0, 4, .. 20)."""
    hour = F.floor(F.pmod(F.unix_micros(ts), F.lit(DAY_US)) / F.lit(HOUR_US))
    return (hour - hour % PART_HOURS).cast("int")


def _part_of(ts: Column) -> Column:
    """The number of the partition an instant falls in."""
    return F.floor(F.unix_micros(ts) / F.lit(PART_HOURS * HOUR_US)) * PART_HOURS


def _within(df: DataFrame, lo: Column | None, hi: Column | None, closed: str, ts: str) -> DataFrame:
    t = F.col(ts)
    if ts == LAYOUT_TS and UNCUT_TS in df.columns:
        # implied by the bounds of ts, which is at most a second less
        if lo is not None:
            df = df.filter(F.col(UNCUT_TS) >= lo)
        if hi is not None:
            df = df.filter(F.col(UNCUT_TS) < shift(hi, 1, "SECOND"))
    if lo is not None:
        df = df.filter(t > lo if closed == "none" else t >= lo)
    if hi is not None:
        df = df.filter(t <= hi if closed == "both" else t < hi)
    return df


def time_slice(df: DataFrame, lo: Column | None = None, hi: Column | None = None,
               closed: str = "both", ts: str = "ts") -> DataFrame:
    """Rows between ``lo`` and ``hi``; either may be None for an open side.

    ``closed`` says which bounds belong to the slice: ``both``, ``left`` (half open) or ``none``.

    On a table in the ``time`` layout the slice is the partitions that lie wholly inside, taken as
    they are, and the matching rows of the partitions the bounds fall in. Everything else is pruned,
    and a count reads the timestamps of the outermost partitions only.
    """
    if closed not in ("both", "left", "none"):
        raise ValueError(f"closed must be both, left or none, not {closed!r}")
    if not _has_time_layout(df, ts) or (lo is None and hi is None):
        return _within(df, lo, hi, closed, ts)
    part, inner, outer = _part_number(), F.lit(True), F.lit(False)
    if lo is not None:
        inner, outer = inner & (part > _part_of(lo)), outer | (part == _part_of(lo))
    if hi is not None:
        inner, outer = inner & (part < _part_of(hi)), outer | (part == _part_of(hi))
    return df.filter(inner).union(_within(df.filter(outer), lo, hi, closed, ts))


def relative_slice(df: DataFrame, back: str, as_of: Column | None = None, ts: str = "ts") -> DataFrame:
    """Rows of the time ``back`` (e.g. ``30 years``) before ``as_of``, which itself is excluded.

    ``as_of`` is given, or the table's latest instant, but never the clock: a query gives the same
    result tomorrow.
    """
    span = F.expr(f"INTERVAL {back}")
    if as_of is None:
        lo, hi = instants(df, F.col("max_ts") - span, F.col("max_ts"), ts=ts)
        return time_slice(df, lo, hi, "left", ts)
    return time_slice(df, as_of - span, as_of, "left", ts)
